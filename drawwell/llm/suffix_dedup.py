"""Removal of repeated byte strings by distributed prefix doubling over a sampled suffix array.

The threshold is T bytes. Positions are ranked by their first T/2 bytes, then by pairs of ranks at offset T/2, and leave
as soon as their rank is unique; a rank is the fingerprint of the bytes it stands for. As T is fixed, one doubling reaches
it.

1. Sampling. Of the T/2+1 half strings inside a T-byte window the one with the least hash is the window's anchor.
   Equal windows have the same anchor at the same place in them, so ranking anchors alone loses nothing. Consecutive
   windows with one anchor are a run; about one position in T/4 is an anchor.
2. First round: Spark sorts the runs by the rank of their anchor and by all their bytes. A unique anchor ends all windows
   of its run. Runs with the same bytes throughout are a class: if it has several, they are repeated, and one member
   stands for it in the next round if its anchor has other classes too.
3. Second round: the windows of those members, at all their positions, are ranked by the pair (rank at s, rank at
   s + T/2) and sorted by Spark; equal neighbours are repeated strings. Equal windows have equal anchors, so the sort goes
   by anchor and part of a run first, which keeps neighbouring positions of a document together: they leave as a range.
   The texts come to the members by a join on the row's id.
4. Covered ranges are merged by document, and what remains of each text is hashed.

What a batch of rows already finds twice in itself is settled there, and one row of it goes into the sort, so a string
that very many documents share sends a row a batch, not a row a document. The sorts stream through their rows, and no
group is collected. The texts are first stored with an id for each row, so every later reading names the same rows.
Broadcast are only filters of row ids, MAX_FILTER_BITS at most; beyond that more texts are shuffled than need be, each
once, and dropped by the join. Ranks carry 128 bits in both sorts.

Defined cases: a null text counts as empty; texts shorter than T are never touched; rows repeated in full are copies of
each other like any others; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawwell.llm.common import stored, table

THRESHOLD = 200
MAX_FILTER_BITS = 1 << 28
BITS_PER_ENTRY = 16
#: Bytes that are hashed together; windows across the border belong to the part in which they start.
PART_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PLACE_BITS = 21
_OUT = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def _half(threshold: int) -> int:
    """Bytes of a half string; the two halves of an odd threshold share one."""
    return (threshold + 1) // 2


class Hasher:
    """Rolling hashes of one part of a text at a time."""

    def __init__(self, threshold: int, base: int = _BASE):
        size = PART_BYTES + threshold + 1
        self.up, self.down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        np.multiply.accumulate(np.full(size - 1, base, np.uint64), out=self.up[1:])
        np.multiply.accumulate(np.full(size - 1, pow(base, -1, 1 << 64), np.uint64), out=self.down[1:])

    def prefixes(self, part: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.up[: len(part)], out=sums[1:])
        return sums

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((sums[end] - sums[start]) * self.down[start])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    rows = -(-len(values) // width)
    block = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    block[: len(values)] = values
    block = block.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(values) - width + 1], ahead[width - 1 : len(values)])


class Runs:
    """The runs of a part: rank of the anchor, hash of all bytes, first and last window start, and the hash sums."""

    def __init__(self, hasher: Hasher, part: np.ndarray, threshold: int):
        half = _half(threshold)
        self.sums = hasher.prefixes(part)
        at = np.arange(len(part) - half + 1)
        ranks = hasher.between(self.sums, at, at + half)
        low = np.uint64((1 << _PLACE_BITS) - 1)
        anchor = (sliding_least((ranks & ~low) | at.astype(np.uint64), threshold - half + 1) & low).astype(np.int64)
        self.first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        self.last = np.append(self.first[1:] - 1, len(anchor) - 1)
        self.place = place = anchor[self.first]
        self.anchor, self.ranks = ranks[place], ranks
        shape = (place - self.first).astype(np.uint64) << np.uint64(32) | (self.last - self.first).astype(np.uint64)
        self.whole = hasher.between(self.sums, self.first, self.last + threshold) ^ _mix(shape + np.uint64(1))


def parts(text: str | None, threshold: int):
    """(start, bytes) of the parts of a text that hold a whole window."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    for at in range(0, len(data), PART_BYTES):
        if len(part := data[at : at + PART_BYTES + threshold - 1]) >= threshold:
            yield at, part


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


#: A row of a sort: a range of its own (start, size in b, x), or a run with its rank (a, b) and code x.
_ROWS = "range boolean, a long, b long, key long, x long"
_WINDOWS, _BEFORE = np.int64((1 << 12) - 1), np.int64((1 << 12) - 1)


def _code(first: np.ndarray, before: np.ndarray | int, windows: np.ndarray | int) -> np.ndarray:
    """A run in one number: its first window, how far behind that its anchor is, its windows, and a last bit for
    settled."""
    return first << np.int64(25) | np.int64(before) << np.int64(13) | np.int64(windows) << np.int64(1)


def _decoded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x >> np.int64(25), x >> np.int64(13) & _BEFORE, x >> np.int64(1) & _WINDOWS


def _combined(held: list, threshold: int) -> pa.RecordBatch:
    """The rows (a, b, key, x) with one for each rank, settled if there were more, and the ranges that these cover."""
    a, b, key, x = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((b, a))
    a, b, key, x = a[order], b[order], key[order], x[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    opens, twice = np.concatenate(([True], ~same)), np.concatenate(([False], same)) | np.concatenate((same, [False]))
    first, _, windows = _decoded(x[twice])
    ranges = _merged(key[twice], first, windows + (threshold - 1))
    keys, start, size = (c.to_numpy() for c in ranges.columns)
    a, b, key, x = a[opens], b[opens], key[opens], x[opens] | twice[opens]
    columns = [np.repeat([True, False], (len(keys), len(a))), *map(np.concatenate, ((_mix(keys.view(np.uint64)).view(np.int64), a.view(np.int64)), (start, b.view(np.int64)), (keys, key), (size, x)))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["range", "a", "b", "key", "x"])


def _first_round(threshold: int):
    def ranked(batches):
        hasher = Hasher(threshold)
        for batch in batches:
            held, rows = [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for offset, part in parts(text.as_py(), threshold):
                    runs = Runs(hasher, part, threshold)
                    code = _code(offset + runs.first, runs.place - runs.first, runs.last - runs.first + 1)
                    held.append((runs.anchor, runs.whole, np.full(len(code), key, np.int64), code))
                    rows += len(code)
                if rows >= _OUT:
                    yield _combined(held, threshold)
                    held, rows = [], 0
            if held:
                yield _combined(held, threshold)

    return ranked


def _judged(threshold: int):
    """From rows in the order of a, b: (key, start, size, before, anchor) of ranges (before is -1), and of the last run of
    each class of an anchor a that has several: its first window, its windows and how far behind its anchor is."""

    def found(key, start, size, before, anchor):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (key, start, size, before, anchor)], ["key", "start", "size", "before", "anchor"])

    def ranges(key, start, size):
        n = len(key)
        return found(key, start, size, np.full(n, -1, np.int32), np.zeros(n, np.int64))

    def decide(a, b, key, x, before, first_class, end):
        """What is known of all rows but the last, or with end of all; and what the last one leaves to the next batch."""
        follows = a[1:] == a[:-1]
        same = follows & (b[1:] == b[:-1])
        equal_before, equal_after = np.concatenate(([before], same)), np.concatenate((same, [False]))
        starts = np.concatenate(([True], ~follows))
        first = b[np.flatnonzero(starts)]
        first[0] = first_class
        first = first[np.cumsum(starts) - 1]
        ready = np.ones(len(a), bool)
        ready[-1] = end
        again = ready & (equal_before | equal_after) & (x & 1 == 0)
        start, _, windows = _decoded(x[again])
        out = [ranges(*(c.to_numpy() for c in _merged(key[again], start, windows + (threshold - 1)).columns))]
        stands = ready & ~equal_after & (np.concatenate((follows, [False])) | (first != b))
        start, behind, windows = _decoded(x[stands])
        out.append(found(key[stands], start, windows, behind.astype(np.int32), a[stands]))
        return out, (equal_before[-1], first[-1])

    def judged(batches):
        kept, before, first_class = None, False, None
        for batch in batches:
            is_range, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            _, b, key, x = (c[is_range] for c in columns)
            if len(key):
                yield ranges(key, b, x)
            rows = [c[~is_range] for c in columns]
            if not len(rows[0]):
                continue
            if kept is None:
                first_class = rows[1][0]
            else:
                rows = [np.concatenate(c) for c in zip(kept, rows, strict=True)]
            out, (before, first_class) = decide(*rows, before, first_class, False)
            yield from out
            kept = [c[-1:] for c in rows]
        if kept is not None:
            yield from decide(*kept, before, first_class, True)[0]

    return judged


def _filter(rows: DataFrame) -> np.ndarray:
    """A filter of the distinct keys of rows; at most MAX_FILTER_BITS."""
    bits, n = 1 << 16, rows.count()
    while bits < BITS_PER_ENTRY * n and bits < MAX_FILTER_BITS:
        bits *= 2
    shift = np.uint64(64 - (bits.bit_length() - 1))

    def placed(batches):
        for batch in batches:
            bit = _mix(batch.column(0).to_numpy().view(np.uint64)) >> shift
            cells = (bit >> np.uint64(6)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cells), _signed(np.uint64(1) << (bit & np.uint64(63)))], ["cell", "bit"])

    found = rows.select("key").mapInArrow(placed, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("cell").to_numpy()] = found.column("mask").to_numpy()
    return out.view(np.uint64)


def _among(rows: DataFrame):
    """A function of a key column: false only for keys that rows don't have."""
    shared = rows.sparkSession.sparkContext.broadcast(_filter(rows))

    @F.arrow_udf("boolean")
    def among(keys: pa.Array) -> pa.Array:
        cells, bit = shared.value, _mix(keys.to_numpy().view(np.uint64))
        bit = bit >> np.uint64(64 - ((len(cells) * 64).bit_length() - 1))
        return pa.array((cells[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool))

    return among


def _second_round(threshold: int):
    half = _half(threshold)

    def windows(hasher: Hasher, data: np.ndarray, first, size, before, anchor):
        """Ranks (unit, pair) and starts of all windows of runs that start in one part of a text."""
        at = int(first[0]) // PART_BYTES * PART_BYTES
        sums = hasher.prefixes(data[at : at + PART_BYTES + threshold - 1])
        first, place = first - at, first - at + before
        if (hasher.between(sums, place, place + half).view(np.int64) != anchor).any():
            raise RuntimeError("a stored text has changed")
        s = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        behind = np.repeat(place, size) - s  # equal windows have their anchor at one place
        pair = _mix(hasher.between(sums, s, s + half) ^ _mix(hasher.between(sums, s + threshold - half, s + threshold)))
        return _mix(np.repeat(anchor.view(np.uint64), size) + np.uint64(7) * (2 + (behind >> 4)).astype(np.uint64)), pair, at + s

    def ranked(batches):
        hasher = Hasher(threshold)
        for batch in batches:
            held, rows = [], 0
            ends = batch.column(2).offsets.to_numpy()
            first, size, before, anchor = (c.to_numpy().astype(np.int64) for c in batch.column(2).flatten().flatten())
            ends = ends - ends[0]
            for key, text, low, high in zip(batch.column(0).to_pylist(), batch.column(1), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                cuts = low + np.flatnonzero(np.diff(first[low:high] // PART_BYTES, prepend=-1))
                for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), high]):
                    unit, pair, start = windows(hasher, data, first[i:j], size[i:j], before[i:j], anchor[i:j])
                    held.append((unit, pair, np.full(len(start), key, np.int64), _code(start, 0, 1)))
                    rows += len(start)
                    if rows >= _OUT:
                        yield _combined(held, threshold)
                        held, rows = [], 0
            if held:
                yield _combined(held, threshold)

    return ranked


def _merged(key: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """The same ranges with those of one document that touch put together."""
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], (start + size)[order]
    if len(key):
        # no end reaches into the next document once documents are a long way apart
        document = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        apart = document * (int(end.max()) + 1)
        reach = np.maximum.accumulate(end + apart)
        opens = np.flatnonzero(np.concatenate(([True], (start + apart)[1:] > reach[:-1])))
        key, start, end = key[opens], start[opens], np.append(reach[opens[1:] - 1], reach[-1]) - apart[opens]
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(start), pa.array((end - start).astype(np.int64))], ["key", "start", "size"])


_FOUND = "key long, start long, size long, before int, anchor long"


def repeated_ranges(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(key, start, size): byte ranges of docs (key, text) that only hold strings of `threshold` bytes found again. Keys
    are distinct, and reading docs again gives the same rows."""
    sort = lambda rows: rows.repartition("a").sortWithinPartitions("a", "b").mapInArrow(_judged(threshold), _FOUND)
    first = stored(sort(docs.mapInArrow(_first_round(threshold), _ROWS)), "suffix-runs")
    runs = first.where("before >= 0").groupBy(F.col("key").alias("own"))
    runs = stored(runs.agg(F.array_sort(F.collect_list(F.struct("start", "size", "before", "anchor"))).alias("runs")), "suffix-again")
    among = _among(runs.withColumnRenamed("own", "key"))
    again = docs.where(among("key")).join(runs, F.col("key") == F.col("own")).select("key", "text", "runs")
    second = sort(again.mapInArrow(_second_round(threshold), _ROWS))
    return first.unionByName(second).where("before < 0").select("key", "start", "size")


def removed_spans(ranges: DataFrame) -> DataFrame:
    """(key, spans): the maximal ranges of each document, in order, as an array of (start, end)."""
    by_start = Window.partitionBy("key").orderBy("start")
    ends = ranges.groupBy("key", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = ends.withColumn("opens", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    numbered = opened.withColumn("span", F.sum("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("key", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


@F.arrow_udf(T.BinaryType())
def without_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The bytes of a text outside its spans."""
    out = []
    for text, own in zip(texts, spans.to_pylist(), strict=True):
        data, at, left = (text.as_py() or "").encode(), 0, []
        for s in own or ():
            left.append(data[at : s["start"]])
            at = s["end"]
        out.append(b"".join([*left, data[at:]]))
    return pa.array(out, pa.binary())


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_bytes, spans and kept (the remaining bytes) of every row of docs (doc_id, text)."""
    keyed = stored(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("key")), "suffix-docs", "zstd")
    spans = stored(removed_spans(repeated_ranges(keyed.select("key", "text"), threshold)), "suffix-spans")

    # only texts that may have lost something are shuffled
    marked = keyed.withColumn("maybe", _among(spans)("key"))
    touched = marked.where("maybe").join(spans.withColumnRenamed("key", "own"), F.col("key") == F.col("own"), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    touched = touched.select("doc_id", "text", F.coalesce("spans", none).alias("spans")).withColumn("kept", without_spans("text", "spans"))
    clean = marked.where("NOT maybe").select("doc_id", "text", none.alias("spans"), F.coalesce("text", F.lit("")).cast("binary").alias("kept"))
    whole = clean.unionByName(touched)
    return whole.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "spans", "kept")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole document without strings of 200 bytes that occur again."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
