"""Near-duplicates by SimHash, with candidates from a pigeonring.

The 64 bits are a ring of five segments. If two fingerprints differ in at most four bits, then some segment starts a
chain whose first segment is equal, whose first two differ in at most one bit, the first three in at most two, and so
on round the ring: cumulative differences stay within budgets in proportion to the length. Fingerprints are therefore
brought together on an equal segment and a next segment with one bit masked out; in such a group the rest of the chain
is checked before the whole distance. Exact copies are one fingerprint from the start.

A group of fingerprints yields a spanning forest of its links, never all its pairs. A group beyond GROUP_ROWS is cut
into blocks and each pair of blocks is compared in a task of its own, so no task holds more than two blocks. Rows whose
fingerprint, component or centre holds one in a thousand of all rows are not shuffled by it (hot_join).

Defined cases: a null or empty text has fingerprint zero and is linked like any other; a null doc_id never names a
component unless all its ids are null; repeated rows stay separate rows of one class; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawwell.llm.common import hot_join, stored, table, unused
from drawwell.llm.components import connected_components

SHINGLE = 4
MAX_DISTANCE = 4
SEED = 42
GROUP_ROWS = 4096
#: First bit and width of each segment of the ring.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_STEP = 1 << 14


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """SimHash of a text's shingles of words, A-Z in lower case; a bit is set if more than half the hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    ends = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        part = hashes[at : at + _STEP].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def simhash(texts: pa.Array) -> pa.Array:
    """Fingerprints as longs of the same bits."""
    return pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64))


def ring_keys(fp: Column) -> Column:
    """Keys on which fingerprints meet: segment i, and segment i+1 with bit j masked out, for all i and j."""
    cut = lambda s: F.shiftrightunsigned(fp, s[0]).bitwiseAND(F.lit((1 << s[1]) - 1).cast("long"))
    keys = []
    for i, s in enumerate(SEGMENTS):
        t = SEGMENTS[(i + 1) % len(SEGMENTS)]
        for j in range(t[1]):
            masked = cut(t).bitwiseAND(F.lit(((1 << t[1]) - 1) & ~(1 << j)).cast("long"))
            name = F.lit((i * 13 + j) << 26).cast("long")
            keys.append(name.bitwiseOR(F.shiftleft(cut(s), 13)).bitwiseOR(masked))
    return F.array(*keys)


def _links(fps: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which pairs are linked, by the budgets along each chain and then by the whole distance."""
    diff = fps[:, None] ^ other[None, :]
    parts = [np.bitwise_count((diff >> np.uint64(at)) & np.uint64((1 << width) - 1)) for at, width in SEGMENTS]
    possible = np.zeros(diff.shape, bool)
    for i in range(len(parts)):
        total, chain = np.zeros(diff.shape, np.uint8), np.ones(diff.shape, bool)
        for used in range(len(parts)):
            total = total + parts[(i + used) % len(parts)]
            chain &= total * len(parts) <= MAX_DISTANCE * (used + 1)
        possible |= chain
    return possible & (sum(parts, np.zeros(diff.shape, np.uint8)) <= MAX_DISTANCE)


def spanning_forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges (place, place) that connect whatever links within at most two blocks connect."""
    root = list(range(len(fps)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for at in range(0, len(fps), 256):
        rows, columns = np.nonzero(_links(fps[at : at + 256], fps[at:]))
        for x, y in zip((rows + at).tolist(), (columns + at).tolist(), strict=True):
            if x < y and (a := find(x)) != (b := find(y)):
                root[max(a, b)] = min(a, b)
                out.append((x, y))
    return out


_EDGES = "key long, a long, b long, block long"


def _grouped(group_rows: int):
    """From rows (key, fp) in the order of key: edges of each group, and for groups beyond group_rows also the members
    of each of their blocks (b is null)."""

    def edges(batches):
        key_left, left, blocks = None, np.zeros(0, np.uint64), 0

        def batch(rows):
            k, a, b, n = zip(*rows, strict=True) if rows else ((), (), (), ())
            names = ["key", "a", "b", "block"]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k, a, b, n)], names)

        def done(key, fps, number, last):
            signed = fps.view(np.int64).tolist()
            out = [(key, signed[x], signed[y], None) for x, y in spanning_forest(fps)] if len(fps) > 1 else []
            if number or not last:
                out += [(key, x, None, number) for x in signed]
            return out

        for found in batches:
            keys, fps = found.column(0).to_numpy(), found.column(1).to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            ends, rows = np.append(starts[1:], len(keys)), []
            alone = ends - starts == 1
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                inner = 0 < i < len(starts) - 1
                if inner and alone[i]:
                    continue
                if keys[a] != key_left:
                    rows += done(key_left, left, blocks, True)
                    key_left, left, blocks = int(keys[a]), fps[a:a], 0
                left = np.concatenate((left, fps[a:b]))
                while len(left) > group_rows:
                    rows += done(key_left, left[:group_rows].copy(), blocks, False)
                    left, blocks = left[group_rows:], blocks + 1
            yield batch(rows)
        yield batch(done(key_left, left.copy(), blocks, True))

    return edges


def _paired(key, table):
    fps = table.column("a").to_numpy().view(np.uint64)
    signed = fps.view(np.int64).tolist()
    pairs = spanning_forest(fps)
    return pa.table({"a": pa.array([signed[x] for x, _ in pairs], pa.int64()), "b": pa.array([signed[y] for _, y in pairs], pa.int64())})


def fingerprint_links(fps: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp: long) that connect all that links connect."""
    keyed = fps.select(F.explode(ring_keys(F.col("fp"))).alias("key"), "fp")
    sorted_ = keyed.repartition("key").sortWithinPartitions("key", "fp")
    found = stored(sorted_.mapInArrow(_grouped(group_rows), _EDGES), "simhash-links")
    edges = found.where("b IS NOT NULL").select("a", "b")
    members = found.where("b IS NULL").select("key", "a", "block")
    blocks = members.groupBy("key").agg(F.max("block").alias("last"))
    spread = members.join(blocks, "key").select("key", "a", F.col("block"), F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("with"))
    spread = spread.where("block <> with").select("key", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), "a")
    across = spread.groupBy("key", "p", "q").applyInArrow(_paired, "a long, b long")
    return edges.unionByName(across)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text), fp, component_id and root (the same for all rows of a component, and for them
    alone) for every row of docs (doc_id, text)."""
    marked = stored(docs.select("doc_id", F.xxhash64("text").alias("tie"), simhash("text").alias("fp")), "simhash")
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "simhash-fps")
    roots = stored(connected_components(fingerprint_links(fps.select("fp"))), "simhash-roots")
    named = fps.join(roots, F.col("fp") == F.col("node")).groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("rows"))
    linked = hot_join(roots, named, "root", "rows", roots.count()).select("node", "root", "component")
    classes = fps.join(linked, F.col("fp") == F.col("node"), "left")
    classes = classes.select("fp", "rows", F.coalesce("component", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    classes = stored(classes, "simhash-classes")
    return hot_join(marked, classes, "fp", "rows", marked.count()).select("doc_id", "tie", "fp", "component_id", "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component of near-duplicates, with all its columns: the one with the least doc_id, then
    the least hash of its text. Rows repeated in full stay once."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    found = stored(near_duplicates(docs), "simhash-rows")
    own, tie = unused("__id", docs.columns), unused("__tie", docs.columns)
    names = F.col("doc_id").alias(own), F.col("tie").alias(tie)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    best = found.groupBy("root").agg(F.min(rank).alias("best"), F.count("*").alias("rows")).where("rows > 1")
    best = best.select("root", "rows", F.col("best.doc_id").alias("best_id"), F.col("best.tie").alias("best_tie"))
    beaten = hot_join(found, best, "root", "rows", found.count()).where(~(same("doc_id", "best_id") & same("tie", "best_tie")))
    beaten = stored(beaten.select(*names).distinct(), "simhash-beaten")
    text_hash = F.xxhash64("text")
    again = F.col("doc_id").eqNullSafe(F.col(own)) & (text_hash == F.col(tie))
    left = docs.join(beaten, again, "left_anti")
    twice = stored(found.groupBy("doc_id", "tie").agg(F.count("*").alias("rows")).where("rows > 1").select(*names), "simhash-twice")
    if twice.isEmpty():
        return left
    once = left.join(twice, again, "left_semi").withColumn(tie, text_hash).dropDuplicates(["doc_id", tie]).drop(tie)
    return left.join(twice, again, "left_anti").unionByName(once)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole document."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
