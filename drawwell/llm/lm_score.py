"""Language-model scores with a weighted backoff automaton.

States are n-grams seen in training; an arc of a state leads on a word to the longest known suffix, with the smoothed
probability of the word; a failure arc leads to the next shorter context at a weight of its own. A text is scored in one
traversal from left to right that carries the state and adds up log-probabilities.

Training counts all tokens of all training texts. Probabilities are interpolated by absolute discounting: an arc has
(c - D) / n plus the failure weight times the shorter context's probability, and the failure weight is what the arcs
of the state leave over, so every state's distribution sums to one. The root is the add-0.5 unigram distribution over
the V training words and one class of unknown words.

The query scores by lm_tables, which walks the same automaton without bounds, built for a chunk of texts at a time, and
keeps n-grams seen once. The automaton here is its form in one process.

The automaton is broadcast, so its size has a bound: the most frequent words get a number (at most max_words), and the
most frequent n-grams of these an arc (at most max_arcs an order); ties at a bound stay out together. No token is left
out by that: any other word has its exact training count too, which is joined to the texts by a shuffle, and is scored
at the root.

Defined cases: a null text counts as empty and has one token, the end; without training texts every probability is 1;
repeated rows count as often as they occur; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawwell.llm.common import fold, stored, table
from drawwell.llm.lm_tables import score_all

ORDER = 3
DISCOUNT = 0.75
MAX_WORDS = 1 << 17
MAX_ARCS = 1 << 19
FOLDS = 5
#: The end of a text. White space can't be part of a word.
END = b"\n"
_FLUSH = 1 << 19
_SHIFT = 20


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def count_words(docs: DataFrame) -> DataFrame:
    """(token, n) over all tokens of the texts."""

    def counted(batches):
        names = ["token", "n"]
        sums: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.binary()), pa.array(sums.values(), pa.int64())], names)
            sums.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                sums.update(tokens(text.as_py()))
                if len(sums) > _FLUSH:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(counted, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def threshold(counts: DataFrame, most: int, least: int = 1) -> int:
    """The smallest count, `least` or more, that at most `most` rows (n) reach. Reads a histogram of the counts, whose
    rows are few: counts that n rows reach differ in at most the square root of twice their sum."""
    total, cut = 0, None
    for r in counts.where(F.col("n") >= least).groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("n")).toLocalIterator():
        total += r["rows"]
        if total > most:
            break
        cut = r["n"]
    return cut if cut is not None else (1 << 62)


class Automaton:
    """words: numbers of words, 1 and up. next[s << SHIFT | w]: (state, log10 of the probability). fail[s]: the state
    for the next shorter context and log10 of the failure weight. State 0 is the root."""

    def __init__(self, words: dict[bytes, int], root: list[float]):
        self.words, self.root = words, root
        self.arcs: dict[int, tuple[int, float]] = {}
        self.fail: list[tuple[int, float]] = [(0, 0.0)]
        self.seen: list[float] = [0.0]
        self.of_word = [0] * (len(root))

    def probability(self, state: int, word: int) -> float:
        """Of a numbered word in a state, by following failure arcs."""
        weight = 0.0
        while state:
            if hit := self.arcs.get(state << _SHIFT | word):
                return 10.0 ** (weight + hit[1])
            state, more = self.fail[state]
            weight += more
        return 10.0 ** (weight + self.root[word])

    def longest(self, state: int, word: int) -> int:
        """The state after a word."""
        while state:
            if hit := self.arcs.get(state << _SHIFT | word):
                return hit[0]
            state = self.fail[state][0]
        return self.of_word[word]

    def grow(self, keys: np.ndarray, counts: np.ndarray, leads: bool) -> list[int]:
        """Arcs (state << SHIFT | word, count) of the newest states; with leads each gets a state of its own. Returns
        the new states."""
        totals, taken = {}, {}
        keys, counts = keys.tolist(), counts.tolist()
        for key, n in zip(keys, counts, strict=True):
            s = key >> _SHIFT
            totals[s] = totals.get(s, 0.0) + n - DISCOUNT
        for s, kept in totals.items():
            taken[s] = 1.0 - kept / self.seen[s]
            self.fail[s] = (self.fail[s][0], float(np.log10(taken[s])))
        new, arcs = [], {}
        for key, n in zip(keys, counts, strict=True):
            s, w = key >> _SHIFT, key & ((1 << _SHIFT) - 1)
            back = self.fail[s][0]
            p = (n - DISCOUNT) / self.seen[s] + taken[s] * self.probability(back, w)
            to = self.longest(back, w)
            if leads:
                self.fail.append((to, 0.0))
                self.seen.append(float(n))
                to = len(self.fail) - 1
                new.append(to)
            arcs[key] = (to, float(np.log10(p)))
        self.arcs.update(arcs)
        return new

    def walk(self, words: list[int]) -> float:
        """log10 of the probability of a text's words, without the root's share for words that have no number (0)."""
        arcs, fail, root, of_word = self.arcs, self.fail, self.root, self.of_word
        state, total = 0, 0.0
        for w in words:
            while state:
                hit = arcs.get(state << _SHIFT | w)
                if hit is not None:
                    state, p = hit
                    total += p
                    break
                state, p = fail[state]
                total += p
            else:
                total += root[w]
                state = of_word[w]
        return total


def count_arcs(docs: DataFrame, automaton: Automaton, states: range) -> DataFrame:
    """(key, n) of each (state << SHIFT | word) in the texts, for a state among the newest ones."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(automaton))
    low = states.start

    def counted(batches):
        a = SimpleNamespace(**shared.value)
        held: list[int] = []

        def flush():
            keys, n = np.unique(np.array(held, np.int64), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

        number, arcs, fail, of_word = a.words.get, a.arcs, a.fail, a.of_word
        for batch in batches:
            for text in batch.column(0):
                state = 0
                for token in tokens(text.as_py()):
                    w = number(token, 0)
                    if state >= low and w:
                        held.append(state << _SHIFT | w)
                    while state:
                        hit = arcs.get(state << _SHIFT | w)
                        if hit is not None:
                            state = hit[0]
                            break
                        state = fail[state][0]
                    else:
                        state = of_word[w]
                if len(held) > 2 * _FLUSH:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, order: int = ORDER, max_words: int = MAX_WORDS, max_arcs: int = MAX_ARCS) -> tuple[Automaton, DataFrame, int, int]:
    """The automaton of the texts, the counts of all their words, the number of tokens and of distinct ones."""
    if max(max_words, max_words + (order - 2) * max_arcs) >= 1 << _SHIFT:
        raise ValueError("too many words or states for the keys of arcs")
    counts = stored(count_words(docs), "lm-words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    cut = threshold(counts, max_words)
    frequent = counts.where(F.col("n") >= cut).toArrow()  # at most max_words rows
    found = sorted(zip(frequent.column("token").to_pylist(), frequent.column("n").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    base = float(np.log10(n + 0.5 * (v + 1)))
    automaton = Automaton({t: i + 1 for i, (t, _) in enumerate(found)}, [0.0, *(float(np.log10(c + 0.5)) - base for _, c in found)])
    if order > 1:  # a state for each numbered word but the end, after which nothing follows
        for i, (t, c) in enumerate(found):
            if t != END and c >= 2:
                automaton.of_word[i + 1] = len(automaton.fail)
                automaton.fail.append((0, 0.0))
                automaton.seen.append(float(c))
    first = 1
    for k in range(2, order + 1):
        last = len(automaton.fail)
        if first == last:
            break
        arcs = stored(count_arcs(docs, automaton, range(first, last)), f"lm-{k}-grams")
        kept = arcs.where(F.col("n") >= threshold(arcs, max_arcs, 2)).toArrow()  # at most max_arcs rows
        keys, c = kept.column("key").to_numpy(), kept.column("n").to_numpy()
        by = np.argsort(keys)
        automaton.grow(keys[by], c[by], k < order)
        first = last
    return automaton, counts, int(n), int(v)


_PART = "struct<n:long,known:long,base:double,score:double,rare:array<struct<token:binary,times:long>>>"


def score_texts(docs: DataFrame, automaton: Automaton, counts: DataFrame, n: int, v: int) -> DataFrame:
    """docs (doc_id, text) with n_tokens, n_known, base_score and score."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(automaton))
    kind = pa.list_(pa.struct([("token", pa.binary()), ("times", pa.int64())]))

    @F.arrow_udf(_PART)
    def scored(texts: pa.Array) -> pa.Array:
        a = SimpleNamespace(**shared.value)
        number, root = a.words.get, a.root
        rows = []
        for text in texts:
            own = tokens(text.as_py())
            numbers = [number(t, 0) for t in own]
            rare = Counter(t for t, w in zip(own, numbers, strict=True) if not w) if 0 in numbers else {}
            # root[0] is 0, so words without a number add nothing here
            rows.append((len(own), len(own) - sum(rare.values()), sum([root[w] for w in numbers]), Automaton.walk(a, numbers), [{"token": t, "times": c} for t, c in rare.items()]))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), kind)
        columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        return pa.StructArray.from_arrays(columns, ["n", "known", "base", "score", "rare"])

    parts = docs.select("doc_id", scored("text").alias("p")).select("doc_id", "p.*")
    parts = stored(parts.withColumn("row", F.monotonically_increasing_id()), "lm-parts")
    rare = parts.where(F.size("rare") > 0).select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.times")
    tail = counts.select(F.col("token").alias("t"), F.col("n").alias("c"))
    joined = rare.join(tail, F.col("token") == F.col("t"), "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log = F.col("times") * (F.log10(F.col("c") + 0.5) - F.log10(F.lit(n + 0.5 * (v + 1))))
    added = joined.groupBy(F.col("row").alias("own")).agg(F.sum(log).alias("log"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"))
    whole = parts.drop("rare").join(added, F.col("row") == F.col("own"), "left")
    extra = F.coalesce("log", F.lit(0.0))
    return whole.select(
        "doc_id", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        (F.col("base") + extra).alias("base_score"), (F.col("score") + extra).alias("score"),
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and unigram scores of every whole document, learned from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(F.col("doc_id"), FOLDS) != 1).alias("training"))
    found, n, _ = score_all(docs)
    return found.select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
    )
