"""What the operators of this subpackage share: word patterns, the shared folder, fold tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts, as a Java and RE2 pattern.
SPACE_WORD = r"[^\x20\x09-\x0D]+"

#: Lower-cases A-Z and turns every ASCII character but letters and digits into a space. Bytes from 0x80 on
#: stay, so on UTF-8 this followed by split() gives the words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
ALNUM_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


#: Bytes of rows that a Python worker gets at once, however many rows they are.
BATCH_BYTES = 1 << 22


def prepared(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, and fixes how many parts files are cut into at least: by itself Spark goes by the
    cores of the moment, so a table read again after an executor is lost would be cut elsewhere."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores in front until none of the columns is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="drawwell-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df written once to the shared folder and read back: its lineage ends there, and a lost executor costs
    no more than the tasks that it ran."""
    spark = df.sparkSession
    prepared(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than one in HOT_SHARE of the rows is hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """The inner join of left and right on their column key, which is distinct in right and never null. The column rows of
    right says how many of left's rows (total in all) have the key. What right has for hot keys, fewer than HOT_SHARE
    rows, is broadcast, so left's rows with such a key stay where they are; all others are shuffled."""
    is_hot = F.col(rows) * HOT_SHARE > total
    hot, rest = F.broadcast(right.where(is_hot).drop(rows)), right.where(~is_hot).drop(rows)
    return left.join(hot, key).unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: lambdas evaluate outer expressions for every element."""
    return F.transform(F.array(value), body)[0]
