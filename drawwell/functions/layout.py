"""Where records lie: their lengths, greedy shards, and the index that follows from both."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metadata_json(names: list[str]) -> Column:
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(names))), {"ignoreNullFields": "false"})


def metadata_columns(text: Column, schema: str) -> Column:
    """The way back from metadata_json: a struct of the fields that a schema like "a bigint, b string" names."""
    return F.from_json(text, schema)


def record_length(names: list[str], payload: str = "payload") -> Column:
    """8 bytes of length, the metadata as JSON, and the payload."""
    return (F.lit(8) + F.octet_length(metadata_json(names)) + F.octet_length(payload)).cast("long")


def shard_name(shard_id: str = "shard_id") -> Column:
    return F.format_string("%06d.bin", F.col(shard_id))


def assign_shards(lengths: DataFrame, max_shard_bytes: int, by: str | None = None) -> DataFrame:
    """(sample_id, byte_len) with shard_id: a new shard begins if the open one isn't empty and would pass the limit.

    Each shard depends on the one before, so a cache's lengths pass through one task in order, as a stream of two
    numbers a sample; with `by`, a column that names the cache, caches run beside each other.
    """

    def packed(batches):
        owner, shard, used = None, 0, 0
        for batch in batches:
            out = []
            owners = batch.column(0).to_pylist()
            for own, n in zip(owners, batch.column(2).to_pylist(), strict=True):
                if own != owner:
                    owner, shard, used = own, 0, 0
                if used and used + n > max_shard_bytes:
                    shard, used = shard + 1, 0
                used += n
                out.append(shard)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], ["owner", "sample_id", "byte_len", "shard_id"])

    owner = F.col(by).cast("string") if by else F.lit("")
    rows = lengths.select(owner.alias("owner"), "sample_id", "byte_len")
    rows = (rows.repartition("owner") if by else rows.repartition(1)).sortWithinPartitions("owner", "sample_id")
    out = rows.mapInArrow(packed, "owner string, sample_id long, byte_len long, shard_id long")
    return out.withColumnRenamed("owner", by) if by else out.drop("owner")


def index_entries(sharded: DataFrame) -> DataFrame:
    """The offset of each record in its shard. A shard is bounded by its size limit, so its window is too."""
    before = Window.partitionBy("shard_id").orderBy("sample_id").rowsBetween(Window.unboundedPreceding, -1)
    return sharded.withColumn("offset", F.coalesce(F.sum("byte_len").over(before), F.lit(0)).cast("long"))
