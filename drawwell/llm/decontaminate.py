"""Benchmark decontamination by a prefix-filtered set join.

Each window of an item is a set of shingles with places. A document holds a window only if it holds every one of its
shingles, so the rarest alone is a sufficient prefix for containment. Steps:

1. One pass over the documents finds, through a Bloom filter of all benchmark shingles, the places of possible shingles
   with the words around them. The filter is the only thing broadcast and never exceeds MAX_FILTER_BITS.
2. These places are counted by shingle; every window is keyed by its rarest shingle. A shingle that no document holds
   rules out its windows.
3. Windows and places are joined on that key. Positions bound the start of a window to the document, lengths bound its
   end; the words are then compared one by one, so neither filter nor hashes decide anything.

Defined cases: null texts have no words; an item without words has no window; items with a null item_id count under
empty text; rows with the same item_id are one item, and repeated documents are judged one by one; empty tables give
zero hits; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawwell.llm.common import ALNUM_WORDS, stored, table

WINDOW = 10
SHINGLE = 5
MAX_FILTER_BITS = 1 << 28
BITS_PER_SHINGLE = 32

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def item_words(text: str | None) -> list[bytes]:
    """Words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z in lower case."""
    return (text or "").encode().translate(ALNUM_WORDS).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words, from the hashes of the words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = out * _FACTOR + hashes[i : i + n]
    return (out ^ (out >> np.uint64(31))) * _FACTOR


def _windows(window: int, shingle: int):
    names = ["item_id", "words", "width", "shingles"]
    kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())]))

    def made(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = item_words(text.as_py())
                size = min(window, len(words))
                width = min(shingle, size)
                if not size:
                    continue
                h = shingle_hashes(word_hashes(words), width).view(np.int64).tolist()
                for at in range(len(words) - size + 1):
                    own = [{"h": h[at + i], "at": i} for i in range(size - width + 1)]
                    rows.append((item, [w.decode() for w in words[at : at + size]], width, own))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = (pa.string(), pa.list_(pa.string()), pa.int32(), kind)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return made


def benchmark_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, words, width, shingles) and which item holds which (wid, item)."""
    texts = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    found = texts.mapInArrow(_windows(window, shingle), "item_id string, words array<string>, width int, shingles array<struct<h:long,at:int>>")
    found = stored(found.withColumn("wid", F.sha2(F.concat_ws(" ", "words").cast("binary"), 256)), "bench-windows")
    windows = found.groupBy("wid").agg(F.first("words").alias("words"), F.first("width").alias("width"), F.first("shingles").alias("shingles"))
    return windows, found.select("wid", F.col("item_id").alias("item")).distinct()


def shingle_filter(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bit array with a bit for every shingle, and the widths that occur."""
    shingles = windows.select("width", F.explode("shingles.h").alias("h")).distinct()
    widths = shingles.groupBy("width").count().orderBy("width").limit(SHINGLE + 1).collect()  # 1 to SHINGLE
    bits = 1 << 16
    while bits < BITS_PER_SHINGLE * sum(r["count"] for r in widths) and bits < MAX_FILTER_BITS:
        bits *= 2
    shingles = shingles.withColumn("place", F.shiftrightunsigned("h", 64 - (bits.bit_length() - 1)))
    # one row for each eight bytes of the filter at most, so no more than MAX_FILTER_BITS in all
    rows = shingles.select(F.shiftright("place", 6).alias("cell"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit"))
    rows = rows.groupBy("cell").agg(F.bit_or("bit").alias("mask")).toArrow()
    cells = np.zeros(bits // 64, np.int64)
    cells[rows.column("cell").to_numpy()] = rows.column("mask").to_numpy()
    return cells.view(np.uint64), [r["width"] for r in widths]


def find_places(docs: DataFrame, cells: np.ndarray, widths: list[int], window: int = WINDOW) -> DataFrame:
    """doc_id, tie (a hash of the text), row, n_words and the places of possible shingles of every row; the words around
    a place are one string, apart by spaces, which no word holds."""
    shared = docs.sparkSession.sparkContext.broadcast(cells)
    names = ["h", "width", "at", "first", "words"]

    @F.arrow_udf("struct<n_words:long,places:array<struct<h:long,width:int,at:int,first:int,words:string>>>")
    def found(texts: pa.Array) -> pa.Array:
        cells = shared.value
        shift = np.uint64(64 - ((len(cells) * 64).bit_length() - 1))
        counts, ends, near = [], [0], []
        # numbers stay in arrays and words in one string a place: lists of Python objects took hundreds of MB a batch
        hs, wide, ats, firsts = ([np.zeros(0, kind)] for kind in (np.int64, np.int32, np.int32, np.int32))
        for text in texts:
            words = item_words(text.as_py())
            hashes = word_hashes(words)
            for width in widths:
                h = shingle_hashes(hashes, width)
                bit = h >> shift
                at = np.flatnonzero((cells[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
                if not len(at):
                    continue
                first = np.maximum(0, at - (window - width))
                hs.append(h[at].view(np.int64))
                wide.append(np.full(len(at), width, np.int32))
                ats.append(at.astype(np.int32))
                firsts.append(first.astype(np.int32))
                near += [b" ".join(words[i : j + window]) for i, j in zip(first.tolist(), at.tolist(), strict=True)]
            counts.append(len(words))
            ends.append(len(near))
        numbers = [pa.array(np.concatenate(x)) for x in (hs, wide, ats, firsts)]
        places = pa.StructArray.from_arrays([*numbers, pa.array(near, pa.binary()).cast(pa.string())], names)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places)], ["n_words", "places"])

    out = docs.select("doc_id", F.xxhash64("text").alias("tie"), found("text").alias("found")).select("doc_id", "tie", "found.n_words", "found.places")
    # the id is written with the row, so it stays the same however often the table is read
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "bench-places")


def window_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, doc_id, tie, n_words) of all docs (doc_id, text), the hits (row, wid, start, size), and (wid, item)."""
    windows, members = benchmark_windows(items, window, shingle)
    windows = stored(windows, "bench-sets")
    rows = find_places(docs, *shingle_filter(windows), window)
    places = rows.where(F.size("places") > 0).select("row", "n_words", F.explode("places").alias("p")).select("row", "n_words", "p.*")

    counts = places.groupBy("h", "width").agg(F.count("*").alias("n"))
    sets = windows.select("wid", "words", "width", F.explode("shingles").alias("s")).select("wid", "words", "width", "s.h", F.col("s.at").alias("offset"))
    ranked = sets.join(counts, ["h", "width"], "left")
    rarest = ranked.groupBy("wid").agg(
        F.first("words").alias("set"), F.first("width").alias("width"),
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset")).alias("prefix"),
    )
    prefixes = rarest.where("prefix.n > 0").select("wid", "set", "width", "prefix.h", "prefix.offset")

    joined = places.join(prefixes, ["h", "width"])
    size, start = F.size("set"), F.col("at") - F.col("offset")
    inside = (start >= F.col("first")) & (start + size <= F.col("n_words"))
    same = F.slice(F.split("words", " "), F.greatest(start - F.col("first") + 1, F.lit(1)), size) == F.col("set")
    hits = joined.where(inside & same).select("row", "wid", start.cast("long").alias("start"), size.cast("long").alias("size"))
    return rows.drop("places"), stored(hits, "bench-hits"), members


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text), n_words, n_hit, n_items, items (a sorted array) and contaminated, for every row
    of docs (doc_id, text)."""
    rows, hits, members = window_hits(docs, items)
    spans = hits.groupBy("row", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    words = spans.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    held = hits.select("row", "wid").distinct().join(members, "wid").select("row", "item").distinct()
    found = held.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items")).join(words, "row")
    joined = rows.join(found, "row", "left")
    return joined.select(
        "doc_id", "tie", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")
