"""Toxicity: logistic regression over hashed word n-grams and skip-grams, fitted with FTRL-proximal.

Every coordinate has a learning rate of its own, and L1 leaves most weights at exactly zero, so the model is a short
list of (coordinate, weight) that is broadcast. It is fitted in one task on a bounded sample: of the distinct labelled
texts those with the smallest hash of doc_id, at most SAMPLE_DOCS of them and SAMPLE_BYTES of text in all. Scoring reads
whole texts of all documents.

Defined cases: null and empty texts have no features and get the score of the bias alone; a null label is no label; of
several labels for one doc_id the largest counts; without any label (or with labels of one class only) all scores are 0;
rows repeated in doc_id and text are learned from once and get the same score; ties in the sample's order go by doc_id,
then by the text's hash; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawwell.llm.common import ALNUM_WORDS, fold, stored, table

BITS = 22
#: Bounds of the sample that the model is fitted on: documents, and bytes of their texts.
SAMPLE_DOCS = 12_000
SAMPLE_BYTES = 1 << 25
EPOCHS = 8
ALPHA, BETA, L1, L2 = 4.0, 1.0, 6.0, 0.0
FOLDS = 5

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: A multiplier for each kind of feature: words, then pairs at distance 1, 2 and 3.
_KINDS = tuple(np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def hashed_features(text: str | None) -> np.ndarray:
    """Coordinates of a text's words, word pairs and skip-grams, repeats included."""
    words = (text or "").encode().translate(ALNUM_WORDS).split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)
    parts = [h * _KINDS[0]]
    for gap in (1, 2, 3):
        if len(h) > gap:
            parts.append((h[:-gap] * _GOLDEN + h[gap:]) * _KINDS[gap])
    x = np.concatenate(parts)
    x ^= x >> np.uint64(29)
    return ((x * _GOLDEN) >> np.uint64(64 - BITS)).astype(np.int32)


def fit_ftrl(features: list[np.ndarray], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) of a model fitted on sets of coordinates, taken in the order given."""
    size = 1 << BITS
    z, n = np.zeros(size, np.float32), np.zeros(size, np.float32)
    z0 = n0 = 0.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for x, y in zip(features, labels, strict=True):
            zi, ni = z[x], n[x]
            w = weights(zi, ni)
            b = -z0 / ((BETA + n0**0.5) / ALPHA)
            g = float(1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30)))) - y
            z[x] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[x] = ni + g * g
            z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / ALPHA * b
            n0 += g * g
    at = np.flatnonzero(np.abs(z) > L1)
    return at, weights(z[at], n[at]).astype(np.float64), -z0 / ((BETA + n0**0.5) / ALPHA)


@F.arrow_udf(T.BinaryType())
def packed_features(texts: pa.Array) -> pa.Array:
    """The distinct coordinates of each text, four bytes each."""
    return pa.array([np.unique(hashed_features(t.as_py())).tobytes() for t in texts], pa.binary())


def sampled(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(id, tie, toxic): distinct labelled texts of docs (doc_id, text) within both bounds."""
    label = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    first = label.orderBy(F.xxhash64("id"), "id").limit(sample_docs)  # broadcast below: at most sample_docs rows
    sized = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    rows = sized.join(F.broadcast(first), F.col("doc_id") == F.col("id")).select("id", "tie", "toxic", "size").distinct()
    order = [F.xxhash64("id"), F.col("id"), F.col("tie")]
    whole = rows.orderBy(*order).limit(sample_docs)
    sums = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over sample_docs rows at most
    return whole.withColumn("bytes", sums).where(F.col("bytes") <= sample_bytes).select("id", "tie", "toxic")


class ToxicityModel:
    """A fitted model; score() makes a column of probabilities."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, bias: float):
        self.at, self.weights, self.bias = at, weights, bias

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> ToxicityModel:
        """Fit on documents (doc_id, text) that labels (doc_id, toxic) cover."""
        picked = stored(sampled(docs, labels, sample_docs, sample_bytes), "toxicity-sample")
        own = (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("tie"))
        rows = docs.select("doc_id", "text").join(F.broadcast(picked), own)  # at most sample_docs rows
        rows = rows.select("id", "tie", "toxic", packed_features("text").alias("x")).groupBy("id", "tie", "toxic").agg(F.first("x").alias("x"))

        def fitted(batches):
            found = []
            for batch in batches:
                for doc_id, tie, toxic, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found.append((zlib.crc32(str(doc_id).encode()), doc_id, tie, toxic, x))
            found.sort()
            labels = [r[3] for r in found]
            if len(set(labels)) == 2:
                at, w, bias = fit_ftrl([np.frombuffer(r[4], np.int32) for r in found], labels)
                at, w = np.append(at, -1), np.append(w, bias)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["at", "weight"])

        # At most 2**BITS rows, and with L1 far fewer; one task gets the sample's features, which its bounds bound.
        model = rows.repartition(1).mapInArrow(fitted, "at long, weight double").toArrow()
        at, w = (model.column(i).to_numpy() for i in range(2))
        if not len(at):
            return cls(at, w, -np.inf)
        real = at >= 0
        return cls(at[real], w[real], float(w[~real][0]))

    def score(self, spark: SparkSession, text: Column) -> Column:
        shared = spark.sparkContext.broadcast((self.at, self.weights, self.bias))
        dense = []

        @F.arrow_udf("double")
        def scores(texts: pa.Array) -> pa.Array:
            at, weights, bias = shared.value
            if not dense:
                dense.append(np.zeros(1 << BITS, np.bool_))
                dense[0][at] = True
            out = []
            for text in texts:
                x = hashed_features(text.as_py())
                hit = np.unique(x[dense[0][x]])
                total = bias + weights[np.searchsorted(at, hit)].sum()
                out.append(0.0 if total == -np.inf else float(1 / (1 + np.exp(-np.clip(total, -500, 500)))))
            return pa.array(out, pa.float64())

        return scores(text)


def fold_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    """The model of the labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold(F.col("doc_id"), FOLDS) != 0)
    return ToxicityModel.fit(docs, labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fold_model(spark, docs, sf_dir)
    scored = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), model.score(spark, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
