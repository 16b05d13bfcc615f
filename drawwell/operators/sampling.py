"""Sequences of draws: cyclic windows, and reproducible draws with replacement.

Draw k of a seed depends on (seed, k) alone. The first 60 bits of a SHA-256 are scaled to the total weight, which is a
sum of integers: weights are taken in units of the largest one over 2**S, at least one unit each. So results are exact
and don't depend on partitions or on the order in which anything is added up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawwell.operators.active import POS
from drawwell.sources.shared import snapshot

BITS = 60


def sequential(spark: SparkSession, start: int, length: int, population: int) -> DataFrame:
    """(seq, active_pos) of a window over the active order, which it goes round as often as needed."""
    return spark.range(length).select(F.col("id").alias("seq"), F.pmod(F.col("id") + start % population, F.lit(population)).alias(POS))


def draw_hash(seed: int, draw: Column) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), draw.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("decimal(19,0)")


def uniform_draws(spark: SparkSession, seed: int, start: int, length: int, population: int) -> DataFrame:
    """(seq, active_pos): equal weights need no join."""
    draws = spark.range(length).select(F.col("id").alias("seq"), (F.col("id") + start).alias("draw"))
    product = draw_hash(seed, F.col("draw")) * F.lit(population).cast("decimal(19,0)")
    return draws.withColumn("__p", product).selectExpr("seq", f"cast(__p div cast({1 << BITS} as decimal(19,0)) as bigint) AS {POS}")


def weight_ranges(active: DataFrame) -> tuple[DataFrame, int]:
    """(active_pos, lo, hi) of each row in units of weight, and their total. Sums run inside blocks of positions, and
    then over the blocks."""
    n, most = active.agg(F.count("*"), F.max(F.col("weight").cast("double"))).first()
    bits = min(40, 62 - max(1, math.ceil(math.log2(max(n, 2)))))
    units = F.greatest(F.lit(1).cast("long"), F.floor(F.col("weight") / F.lit(most) * F.lit(float(1 << bits))).cast("long"))
    rows = active.select(POS, units.alias("q")).withColumn("block", F.expr(f"{POS} div 65536"))
    inner = Window.partitionBy("block").orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy("block").agg(F.sum("q").alias("n"))
    outer = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("before"))
    local = rows.withColumn("local", F.sum("q").over(inner)).join(blocks, "block")
    hi = F.col("before") + F.col("local")
    ranges = snapshot(local.select(POS, (hi - F.col("q")).alias("lo"), hi.alias("hi")), "ranges")
    return ranges, int(ranges.agg(F.coalesce(F.max("hi"), F.lit(0))).first()[0])


def weighted_draws(active: DataFrame, seed: int, start: int, length: int) -> DataFrame:
    """(seq, active_pos) of draws with replacement, by weight.

    A draw meets the rows whose range touches its bucket of the number line. There are as many buckets as rows, so
    ranges cover twice as many buckets as there are rows at most, whatever the weights.
    """
    ranges, total = weight_ranges(active)
    n = ranges.count()
    width = max(1, total // max(1, n))
    draws = active.sparkSession.range(length).select(F.col("id").alias("seq"), (F.col("id") + start).alias("draw"))
    draws = draws.withColumn("__p", draw_hash(seed, F.col("draw")) * F.lit(total).cast("decimal(19,0)"))
    draws = draws.selectExpr("seq", f"cast(__p div cast({1 << BITS} as decimal(19,0)) as bigint) AS x").withColumn("bucket", F.expr(f"x div {width}L"))
    spread = ranges.select(POS, "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}L"), F.expr(f"(hi - 1) div {width}L"))).alias("bucket"))
    return draws.join(spread, "bucket").where("x >= lo AND x < hi").select("seq", POS)
