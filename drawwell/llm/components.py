"""Connected components of a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawwell.llm.common import hot_join, stored

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b: long), root being the smallest node of its component.

    Each step replaces edges by edges to the smallest neighbour; once nothing changes all edges lead to roots. Edges stay
    as many as the first ones at most, and each step's are written to the shared folder, so nothing is computed twice.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stored(pairs, "components")
    state = _state(pairs)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # centres of large stars have a large share of the edges, so what they are told is broadcast
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("rows"))
        large = hot_join(both.where("b > a"), low, "a", "rows", 2 * state[0]).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stored(large.where("a <> b").distinct(), "components")
        low = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("rows"))
        small = hot_join(large, low, "a", "rows", large.count()).select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
        pairs = stored(small.where("a <> b").distinct(), "components")
        before, state = state, _state(pairs)
        if before == state:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
    if state[0]:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
