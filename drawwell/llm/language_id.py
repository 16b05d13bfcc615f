"""Language identification as a mixture: a document may hold several languages.

For each language, byte 4-grams of all its training texts are counted in 2**16 hashed bins. A document's 4-grams are
taken as draws from a mixture of the languages' distributions; expectation-maximisation estimates the proportions, and
the set of languages is the one with the best likelihood less a penalty for each further language, in the manner of BIC.

Defined cases: a null text and a text without any letter give `und` with score 0; so does everything if nothing could
be learned; a text too short for any 4-gram gets the language that sorts first, with the probability of a guess; equal
likelihoods go to the language that sorts first; more than MAX_LANGUAGES languages raise; repeated rows get the same
answer; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawwell.llm.common import fold, table

GRAM = 4
BITS = 16
SMOOTHING = 0.5
PENALTY = 4.0
ROUNDS = 12
FOLDS = 4
#: Languages that one model can tell apart: its table is broadcast, with 2**BITS probabilities for each.
MAX_LANGUAGES = 256

#: Spaces in place of ASCII characters that are no letters.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_MULTIPLIER = np.uint32(0x9E3779B1)
_LETTER = regex.compile(r"\p{L}")


def gram_bins(text: str) -> np.ndarray:
    """Hashed bins of the byte 4-grams of a text in lower case, words apart by one space."""
    data = b" ".join((b" " + text.lower().encode().translate(_LETTERS) + b" ").split())
    b = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    if len(b) < GRAM:
        return np.zeros(0, np.int64)
    packed = b[: len(b) - 3] | b[1 : len(b) - 2] << np.uint32(8) | b[2 : len(b) - 1] << np.uint32(16) | b[3:] << np.uint32(24)
    return ((packed * _MULTIPLIER) >> np.uint32(32 - BITS)).astype(np.int64)


def mixture(counts: np.ndarray, probs: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the columns of probs, by EM, and the log-likelihood of counts under them."""
    share = np.full(probs.shape[1], 1 / probs.shape[1])
    total = counts.sum()
    for _ in range(rounds):
        each = probs * share
        share = (each * (counts / each.sum(1))[:, None]).sum(0) / total
    return share, float(counts @ np.log(probs @ share))


class LanguageModel:
    """langs in order, and for each hashed bin its probability in every language."""

    def __init__(self, langs: list[str], probs: np.ndarray):
        self.langs, self.probs = langs, probs

    @classmethod
    def fit(cls, docs: DataFrame) -> LanguageModel:
        """Fit on all rows of docs (text, lang) that have a language."""

        def counted(batches):
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    own = sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                    bins = gram_bins(text.as_py())
                    own += np.bincount(bins, minlength=1 << BITS)
            for lang, own in sums.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], ["lang", "bin", "n"])

        learned = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
        sums = learned.mapInArrow(counted, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
        found = learned.select("lang").distinct().limit(MAX_LANGUAGES + 1).toArrow().column(0).to_pylist()
        if len(found) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        langs = sorted(found, key=lambda x: x.encode())
        rows = sums.toArrow()  # at most 2**BITS rows a language
        counts = np.zeros((1 << BITS, len(langs)))
        place = {lang: i for i, lang in enumerate(langs)}
        column = np.array([place[x] for x in rows.column("lang").to_pylist()], np.int64)
        np.add.at(counts, (rows.column("bin").to_numpy(), column), rows.column("n").to_numpy())
        return cls(langs, (counts + SMOOTHING) / (counts + SMOOTHING).sum(0) if langs else counts)

    def judge(self, text: str | None, penalty: float = PENALTY) -> tuple[list[tuple[str, float]], float]:
        """(language, proportion) of a text, the largest first, and the probability of that language: its proportion, or
        if it is the only one its posterior among all, equally likely before. Without any letter no language and 0."""
        if not text or not self.langs or not _LETTER.search(text):
            return [], 0.0
        bins, counts = np.unique(gram_bins(text), return_counts=True)
        if not len(bins):
            return [(self.langs[0], 1.0)], 1 / len(self.langs)
        probs, counts = self.probs[bins], counts.astype(np.float64)
        alone = counts @ np.log(probs)
        order = [int(np.argmax(alone))]
        if len(self.langs) > 1:  # the others by their share in the full mixture
            share, _ = mixture(counts, probs)
            order += [i for i in np.argsort(-share, kind="stable").tolist() if i != order[0] and share[i] > 1e-3]
        best, chosen, cost = float(alone[order[0]]), [(order[0], 1.0)], penalty * np.log(counts.sum() + 1)
        for k in range(2, len(order) + 1):
            share, likelihood = mixture(counts, probs[:, order[:k]])
            if likelihood - cost <= best:
                break
            best, chosen = likelihood - cost, list(zip(order[:k], share.tolist(), strict=True))
        chosen.sort(key=lambda x: (-x[1], x[0]))
        sure = chosen[0][1] if len(chosen) > 1 else 1 / float(np.exp(alone - alone[order[0]]).sum())
        return [(self.langs[i], p) for i, p in chosen], min(sure, 1.0)

    def languages(self, text: str | None, penalty: float = PENALTY) -> list[tuple[str, float]]:
        """(language, proportion) of a text, the largest first; empty if it has no letter."""
        return self.judge(text, penalty)[0]

    def predict(self, spark: SparkSession, text: Column) -> Column:
        """A column of found, an array of (lang, proportion), and sure, the probability of the first one."""
        shared = spark.sparkContext.broadcast((self.langs, self.probs.astype(np.float32)))
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        made = []

        @F.arrow_udf("struct<found:array<struct<lang:string,share:double>>,sure:double>")
        def predicted(texts: pa.Array) -> pa.Array:
            if not made:
                made.append(LanguageModel(*shared.value))
            told = [made[0].judge(t.as_py()) for t in texts]
            found = pa.array([[{"lang": a, "share": b} for a, b in langs] for langs, _ in told], kind)
            return pa.StructArray.from_arrays([found, pa.array([sure for _, sure in told], pa.float64())], ["found", "sure"])

        return predicted(text)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every whole document, and its proportion or, if it is the only one, its probability."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), FOLDS) == 2
    model = LanguageModel.fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), model.predict(spark, F.col("text")).alias("p")).select("doc_id", "held_out", "p.*")
    first = F.get("found", F.lit(0))
    return found.select(
        "doc_id", "held_out",
        F.coalesce(first["lang"], F.lit("und")).alias("lang_pred"),
        F.col("sure").alias("score"),
        F.array_join(F.transform("found", lambda x: x["lang"]), ",").alias("langs"),
    )
