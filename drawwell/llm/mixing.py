"""Mixing sources to target weights.

1. Every document gets the range of words that it fills in its source's running text; sources are cut into blocks of a
   fixed number of words, the last one shorter.
2. Weights share the total among the sources. A target stops at EPOCHS times its source; the excess is shared again.
3. The mix has output shards of a fixed number of slots. Each slot draws its source with the targets as chances, so the
   counts of a shard are a multinomial draw. A source's slots are numbered through over the shards; slots past its
   quota go to the sources that fell short of theirs, also by number, so totals end at the quotas.
4. Slot k of a source takes block perm(k mod n) of pass k div n, where perm is a pseudorandom permutation of the n
   blocks, another one each pass. Every block is thus taken equally often, up to one, and never more than EPOCHS times.
5. Blocks and documents are joined by block index.

Everything is DataFrame expressions. Draws depend on the seed and on indexes alone, so reruns agree, whatever the
partitions. Running sums are made over sub-buckets of a source and then over sums of sub-buckets, so one hot source is
spread over many tasks.

Defined cases: a null text has size 0 and no words; a null source is a source like any other and comes last; a document
without words is never taken and has taken 0; repeated rows are separate documents; ties in the order of documents are
broken by the text's hash; an empty table gives empty results; a source of size 0 has target 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawwell.llm.common import SPACE_WORD, stored, table

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
EPOCHS = 3
SEED = 42
#: Documents that share one running sum on average, and the least number of such groups in a source.
BUCKET_DOCS = 20_000
MIN_BUCKETS = 64
#: Shards whose counts share one running sum, and slots that are numbered in one task.
BUCKET_SHARDS = 4096
TASK_SLOTS = 1 << 16
#: Sources beyond which their table is joined by a shuffle instead of a broadcast (about 100 bytes each).
MAX_BROADCAST_SOURCES = 100_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST_SOURCES else df


def placed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and start: the place of a document's first word in its source."""
    sized = docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("tie"),
    )
    sized = stored(sized, "mix-sizes")
    buckets = max(MIN_BUCKETS, sized.count() // BUCKET_DOCS)
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    inner = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("before"))
    local = sized.withColumn("local", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    joined = local.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.select("doc_id", "source", "size", (F.col("before") + F.col("local")).alias("start"))


def source_targets(placed: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, weight and target of each source.

    Weights 1, 2, 3, repeating, go by the sources' code points, null last. With sources in the order of size by weight,
    the capped ones come first: the first source that its share of what is left doesn't pass ends them.
    """
    sums = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("weight", 1 + (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    shares = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # what a unit of weight gets if every source before this one is capped
    unit = ranked.withColumn("unit", left / shares).withColumn("place", F.row_number().over(order))
    free = F.col("unit") * F.col("weight") <= epochs * F.col("source_size")
    first = unit.withColumn("first", F.min(F.when(free, F.col("place"))).over(whole))
    final = F.max(F.when(F.col("place") == F.col("first"), F.col("unit"))).over(whole)
    capped = F.col("first").isNull() | (F.col("place") < F.col("first"))
    target = F.when(capped, (epochs * F.col("source_size")).cast("double")).otherwise(final * F.col("weight"))
    return first.select("source", "source_size", "weight", target.cast("double").alias("target"))


def running_before(df: DataFrame, group: str, order: str, value: str, name: str, width: int = BUCKET_SHARDS) -> DataFrame:
    """df with the sum of value over the rows of the group that come before in the order (a long that doesn't repeat in
    a group). Sums run inside stretches of `width` of the order and then over the stretches, so no task gets a whole group."""
    cut = df.withColumn("__stretch", F.expr(f"{order} div {width}L"))
    inner = Window.partitionBy(group, "__stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("__group").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(F.col(group).alias("__group"), F.col("__stretch").alias("__at")).agg(F.sum(value).alias("__sum"))
    sums = sums.select("__group", "__at", F.coalesce(F.sum("__sum").over(outer), F.lit(0)).alias("__before"))
    own = cut.withColumn(name, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    joined = own.join(sums, (F.col(group) == F.col("__group")) & (F.col("__stretch") == F.col("__at")))
    return joined.withColumn(name, F.col(name) + F.col("__before")).select(*df.columns, name)


def _random(*parts: Column | int) -> Column:
    """A pseudorandom long from 0 below 2**52."""
    return F.shiftrightunsigned(F.xxhash64(*(F.lit(p).cast("long") if isinstance(p, int) else p for p in parts)), 12)


def permuted(i: Column, n: Column, key: Column, seed: int = SEED, rounds: int = 3, walks: int = 24) -> Column:
    """Image of i (0 <= i < n) in a pseudorandom permutation of 0 .. n-1 that key selects.

    A Feistel network permutes the pairs of base side, side*side being n or a little more; an image past n is sent
    through again until it falls below n. There are at most 2*sqrt(n)+1 places past n: a walk ends within `walks` steps
    for any n below 130, and beyond that all but surely (a chance under 1e-17).
    """
    side = F.ceil(F.sqrt(n)).cast("long")
    side = F.when(side * side < n, side + 1).otherwise(side)

    def once(x: Column) -> Column:
        step = lambda p, r: F.struct(p["b"].alias("a"), F.pmod(p["a"] + _random(seed, key, r, p["b"]), side).alias("b"))
        start = F.struct((x / side).cast("long").alias("a"), F.pmod(x, side).alias("b"))
        return F.aggregate(F.array(*(F.lit(r).cast("long") for r in range(rounds))), start, step, lambda p: p["a"] * side + p["b"])

    many = F.sequence(F.lit(1), F.lit(walks))
    return F.aggregate(many, once(i), lambda x, _: F.when(x >= n, once(x)).otherwise(x))


@dataclass
class Mix:
    """targets: by source. slots: (shard, slot, source, pass, block), the mix itself. blocks: the parts of documents
    that make up each block. documents: every document with what the mix takes of it."""

    targets: DataFrame
    slots: DataFrame
    blocks: DataFrame
    documents: DataFrame


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, epochs: int = EPOCHS, seed: int = SEED) -> Mix:
    """Mix docs (doc_id, text, source) to the targets of source_targets()."""
    spark = docs.sparkSession
    placed = stored(placed_documents(docs), "mix-placed")
    n_blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    # a source of n words in blocks gives n / blocks words a slot
    slots_for = F.when(n_blocks > 0, F.least(F.round(F.col("target") * n_blocks / F.col("source_size")), epochs * n_blocks)).otherwise(0)
    quotas = source_targets(placed, epochs).select("*", n_blocks.alias("n_blocks"), slots_for.cast("long").alias("quota"))
    quotas = quotas.withColumn("hi", F.sum("quota").over(Window.orderBy(F.col("source").asc_nulls_last())))
    quotas = quotas.withColumn("code", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    targets = stored(quotas.withColumn("lo", F.col("hi") - F.col("quota")), "mix-targets")
    n_sources, total = targets.agg(F.count("*"), F.coalesce(F.max("hi"), F.lit(0))).first()

    # Draw: a number below the total falls into one source's share. Shares are looked up by bins of the number line.
    width = max(1, total // max(1, min(n_sources, 1_000_000)))
    bins = F.explode(F.sequence(F.expr(f"lo div {width}L"), F.expr(f"(hi - 1) div {width}L")))
    shares = _small(targets.where("quota > 0").select("code", "quota", "lo", "hi", bins.alias("bin")), 2 * n_sources)
    drawn = spark.range(total).select("id", F.pmod(_random(seed, F.col("id")), F.lit(max(total, 1))).alias("x"))
    drawn = drawn.withColumn("bin", F.expr(f"x div {width}L")).join(shares, "bin").where("x >= lo AND x < hi")
    drawn = drawn.select(F.expr(f"id div {shard_slots}L").alias("shard"), (F.col("id") % shard_slots).alias("slot"), "code", "quota")

    counts = drawn.groupBy("shard", "code", "quota").agg(F.count("*").alias("n"))
    counts = stored(running_before(counts, "code", "shard", "n", "before"), "mix-counts")

    # Slots past a source's quota, numbered over all sources, go to the places that fell short, numbered likewise.
    over = F.greatest(F.col("before") + F.col("n") - F.col("quota"), F.lit(0)) - F.greatest(F.col("before") - F.col("quota"), F.lit(0))
    have = counts.groupBy("code").agg(F.sum("n").alias("drawn"))
    short = targets.join(have, "code", "left").withColumn("short", F.greatest(F.col("quota") - F.coalesce("drawn", F.lit(0)), F.lit(0)))
    short = short.withColumn("short_hi", F.sum("short").over(Window.orderBy("code"))).where("short > 0")
    filled = short.select("code", F.coalesce("drawn", F.lit(0)).alias("first"), (F.col("short_hi") - F.col("short")).alias("short_lo"), "short")
    spare = counts.select("code", "shard", over.alias("over")).where("over > 0")
    by_code = spare.groupBy("code").agg(F.sum("over").alias("code_over"))
    by_code = by_code.select("code", (F.sum("code_over").over(Window.orderBy("code")) - F.col("code_over")).alias("code_before"))
    spare = running_before(spare, "code", "shard", "over", "in_code").join(_small(by_code, n_sources), "code")
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("over")))
    spare = spare.select("shard", "code_before", "in_code", number.alias("i")).select("shard", (F.col("code_before") + F.col("in_code") + F.col("i") - 1).alias("number"))
    places = filled.select("code", F.posexplode(F.sequence(F.col("first"), F.col("first") + F.col("short") - 1)).alias("j", "k"), "short_lo")
    places = places.select("code", "k", (F.col("short_lo") + F.col("j")).alias("number"))
    moved = spare.join(places, "number").select("shard", "code", "k")

    own = F.least(F.col("n"), F.greatest(F.col("quota") - F.col("before"), F.lit(0)))
    # a row of counts makes up to shard_slots rows, so its bytes say nothing of the work
    dealt = counts.repartition(max(1, min(total // TASK_SLOTS, 1 << 14)), "shard", "code")
    kept = dealt.where(own > 0).select("shard", "code", F.explode(F.sequence(F.col("before"), F.col("before") + own - 1)).alias("k"))
    numbered = kept.unionByName(moved).join(_small(targets.select("code", "source", "n_blocks"), n_sources), "code")
    numbered = numbered.withColumn("pass", F.expr("k div n_blocks")).withColumn("key", F.col("code") * (epochs + 1) + F.col("pass"))
    slots = numbered.select("shard", "code", "source", "pass", "k", permuted(F.expr("k % n_blocks"), F.col("n_blocks"), F.col("key"), seed).alias("block"))

    spans = placed.join(_small(targets.select("code", F.col("source").alias("s"), "source_size", "target"), n_sources), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    block = F.explode(F.sequence(F.expr(f"start div {block_words}L"), F.expr(f"(start + size - 1) div {block_words}L")))
    cut = spans.where("size > 0").select("doc_id", "code", "source", "start", "size", block.alias("block"))
    first = F.greatest(F.col("block") * block_words, F.col("start"))
    last = F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size"))
    blocks = cut.select("code", "source", "block", "doc_id", "start", "size", (first - F.col("start")).alias("from_word"), (last - F.col("start")).alias("to_word"))

    times = slots.groupBy("code", "block").agg(F.count("*").alias("times"))
    taken = blocks.join(times, ["code", "block"]).groupBy("code", "start").agg(F.sum((F.col("to_word") - F.col("from_word")) * F.col("times")).alias("taken"))
    # a document with words is named by its source and start
    some = spans.where("size > 0").join(taken, ["code", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    documents = some.unionByName(spans.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    columns = ("doc_id", "source", "size", "source_size", "target", "taken")
    return Mix(targets, slots.drop("code"), blocks.drop("code", "start", "size"), documents.select(*columns))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each."""
    return mix_sources(table(spark, sf_dir, "documents")).documents.drop("source")
