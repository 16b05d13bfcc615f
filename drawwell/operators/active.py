"""The active table: identity, metadata and weight of every sample, in an order that is a column of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawwell.sources.shared import snapshot
from drawwell.types import InvalidInput

POS = "active_pos"
_IDS, _WEIGHTS = ("bigint", "int"), ("double", "float", "bigint", "int")


def dense_index(df: DataFrame, keys: list, name: str = POS) -> DataFrame:
    """df with a column 0 .. n-1 in the order of keys: a range partitioning, ids inside partitions, and the partitions'
    offsets. The ids are written before they are counted, so they can't change."""
    order = [F.col(f"`{k}`") if isinstance(k, str) else k for k in keys]
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows = snapshot(rows, "dense")
    part = F.shiftright("__id", 33)
    counts = sorted((r["p"], r["count"]) for r in rows.groupBy(part.alias("p")).count().collect())  # one row a partition
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = F.broadcast(df.sparkSession.createDataFrame(offsets or [(0, 0)], "__p long, __offset long"))
    position = (F.col("__offset") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).alias(name)
    return rows.withColumn("__p", part).join(table, "__p").select(*(f"`{c}`" for c in df.columns), position)


def active_table(caches: list[DataFrame], names: list[str]) -> DataFrame:
    """All samples of caches (sample_id and metadata) in the order given, each with weight 1."""
    out, offset = None, 0
    for cache_id, cache in enumerate(caches):
        rows = cache.select(
            F.lit(cache_id).cast("long").alias("cache_id"), "sample_id", *(f"`{c}`" for c in sorted(names)),
            F.lit(1.0).alias("weight"), (F.col("sample_id") + offset).alias(POS),
        )
        out = rows if out is None else out.unionByName(rows)
        if cache_id + 1 < len(caches):
            offset += cache.count()
    return out


def concat(*tables: DataFrame) -> DataFrame:
    """Tables one after the other. Positions stay distinct and keep the order of tables and of rows in each."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn("segment", F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return dense_index(out.drop(POS) if POS not in out.columns else out.withColumnRenamed(POS, "__at"), ["segment", "__at"]).drop("segment", "__at")


def head(table: DataFrame, n: int) -> DataFrame:
    return table.orderBy(POS).limit(n)


def tail(table: DataFrame, n: int) -> DataFrame:
    return table.orderBy(F.desc(POS)).limit(n).orderBy(POS)


def class_balanced(table: DataFrame, label: str) -> DataFrame:
    """Weights of one over the size of a row's class."""
    counts = table.groupBy(label).agg(F.count("*").alias("__n")).withColumnRenamed(label, "__label")  # AQE broadcasts few labels
    joined = table.join(counts, F.col(label).eqNullSafe(F.col("__label")))
    return joined.withColumn("weight", 1.0 / F.col("__n")).drop("__n", "__label")


def _bad_weight() -> Column:
    w = F.col("weight").cast("double")
    return F.isnan(w) | (w <= 0) | (w == float("inf"))


def check_schema(table: DataFrame, stored: T.StructType) -> None:
    """V1-V3 and V5, from the schema alone."""
    types = dict(table.dtypes)
    for f in stored.fields:
        if f.name not in types:
            raise InvalidInput(f"samples metadata missing '{f.name}' column")
        if types[f.name] != f.dataType.simpleString():
            raise InvalidInput(f"samples metadata column '{f.name}' must have Arrow type {f.dataType.simpleString()}")
    for c in ("cache_id", "sample_id", "weight"):
        if c not in types:
            raise InvalidInput(f"samples metadata missing '{c}' column")
        if types[c] not in (_WEIGHTS if c == "weight" else _IDS):
            raise InvalidInput(f"samples metadata column '{c}' must be {'numeric' if c == 'weight' else 'an integer'}")


def unknown_identities(table: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows whose (cache_id, sample_id) no cache has. counts (cache, n) has a row a cache, so it is broadcast."""
    own = (F.col("cache_id") == F.col("cache")) & (F.col("sample_id") < F.col("n")) & (F.col("sample_id") >= 0)
    return table.join(F.broadcast(counts), own, "left_anti")


def violations(table: DataFrame) -> DataFrame:
    """One row: how many rows break each rule on values (V4, V6, V8, V9), from one pass."""
    count = lambda c: F.count(F.when(c, 1))
    return table.agg(
        F.count("*").alias("n_rows"),
        *(count(F.col(c).isNull()).alias(f"{c}_null") for c in ("cache_id", "sample_id", "weight")),
        *(count(F.col(c) < 0).alias(f"{c}_negative") for c in ("cache_id", "sample_id")),
        count(_bad_weight()).alias("weight_bad"),
        F.min(F.when(_bad_weight(), F.col(POS))).alias("first_bad_weight"),
    )


def validate(table: DataFrame, stored: T.StructType, counts: DataFrame) -> None:
    """All rules in order; raises at the first that fails. table has dense positions."""
    check_schema(table, stored)
    r = violations(table).first()
    for c in ("cache_id", "sample_id", "weight"):
        if r[f"{c}_null"]:
            raise InvalidInput(f"samples metadata column '{c}' contains null")
    for c in ("cache_id", "sample_id"):
        if r[f"{c}_negative"]:
            raise InvalidInput(f"samples metadata column '{c}' must be non-negative")
    first = unknown_identities(table, counts).orderBy(POS).select("cache_id", "sample_id").limit(1).collect()
    if first:
        raise InvalidInput(f"unknown samples metadata row identity cache_id={first[0][0]} sample_id={first[0][1]}")
    if not r["n_rows"]:
        raise InvalidInput("metadata table must include at least one sample")
    if r["weight_bad"]:
        raise InvalidInput(f"weight {r['first_bad_weight']} must be positive and finite")


def sorted_at_top(table: DataFrame) -> bool:
    """Whether the rows come in a global order that the table was given last."""
    node = table._jdf.queryExecution().analyzed()
    while (kind := node.getClass().getSimpleName()) in ("Project", "Filter", "GlobalLimit", "LocalLimit", "SubqueryAlias"):
        node = node.child()
    return kind == "Sort" and getattr(node, "global")()


def positions_repeat(table: DataFrame) -> bool:
    return not table.groupBy(POS).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def ordered(table: DataFrame, order_by: list | None = None) -> DataFrame:
    """table with dense positions: by order_by, else by the order that the table was sorted in last, else by the
    positions it has, else by identity. Ties go by weight, then by a hash of the row, so the result doesn't depend on
    partitions."""
    if not order_by and sorted_at_top(table):
        # partitions of a sorted table follow each other, and so do these ids
        return dense_index(table.withColumn("__row", F.monotonically_increasing_id()).drop(POS), ["__row"]).drop("__row")
    keys = list(order_by or ([POS] if POS in table.columns else ["cache_id", "sample_id"]))
    rest = [c for c in table.columns if c != POS]
    ties = ["weight", F.xxhash64(*(F.col(f"`{c}`") for c in rest))]
    if POS in table.columns:
        table = table.withColumnRenamed(POS, "__pos")
        keys = ["__pos" if isinstance(k, str) and k == POS else k for k in keys]
    return dense_index(table, [*keys, *ties]).drop("__pos")
