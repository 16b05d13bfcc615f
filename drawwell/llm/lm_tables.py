"""The backoff model of lm_score without bounds: tables of all n-grams, in shards that grow in number with the input.

Order 3. The arcs of a state are the table rows that share its context, its failure weight is what they leave over
(DISCOUNT * distinct / n), and a text's score is the sum over its tokens of log10 of

    p3 = (c3 - D) / n(ab) + fail(ab) * p2,    p2 = (c2 - D) / n(b) + fail(b) * p1,    p1 = (c1 + 0.5) / (n + 0.5 (V + 1))

where a context that training didn't see is no state: the walk is in the longest one that it did see. An arc weighs p3 or
p2 of its word, the root's p1, a failure arc fail(ab) or fail(b), the rest of a probability for words without an arc. All n-grams of the training texts
have their exact counts in this, those seen once too; none is left out for its rank, its words or its context.

No process holds the model. The texts are cut into chunks. A chunk sends each shard the n-grams of its texts with their
counts in training (0 where it only asks), the shard adds up all chunks' counts and answers each chunk in the order of
its keys; single words go through shards of their own. From the answers a chunk builds the part of the automaton that its
texts can reach, and scores them in one traversal from left to right that carries the state from token to token.

Words are 64-bit hashes, and so are n-grams within a shard. Chunks are cut from the partitions of the input, so reading
it again must give the same rows in the same order, as files do; a chunk whose keys differ from those it sent raises.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawwell.llm.common import stored

DISCOUNT = 0.75
#: Bytes of text for each shard of n-grams, and in a chunk.
SHARD_BYTES = 1 << 24
CHUNK_BYTES = 1 << 23
#: Frequent words that blobs name by 16-bit numbers, and bytes of text that they are looked for in.
BOOK_WORDS = (1 << 16) - 1
BOOK_BYTES = 1 << 22
#: The n-grams of one first word are spread over so many shards at most.
SPREAD = 16
_BLOCK = 1 << 20
#: Tokens whose arcs are listed at a time in a traversal.
_WALK = 1 << 16
_MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93
_NONE = np.empty(0, np.uint64)
_PAD, _END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(_ODD) + b)


def _bytes_table() -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each byte, lower-cased, 0 for white space; and which bytes are white space."""
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    return np.where(space, np.uint64(0), mix((lower + np.uint64(1)) * np.uint64(_ODD))), space


def powers(of: int, n: int) -> np.ndarray:
    out = np.full(n, of & _MASK, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Tokens:
    """Hashes of the tokens of texts: h in a row, an end after each text's words; is_end; sizes: tokens of each text."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.binary()).cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        table, spaces = _bytes_table()
        space = spaces[data]
        opens = np.ones(len(data) + 1, bool)
        opens[1:-1] = space[:-1]
        opens[offsets] = True
        starts = np.flatnonzero(~space & opens[:-1])
        edges = [*np.searchsorted(starts, np.arange(0, len(data), _BLOCK)).tolist(), len(starts)]
        up, down = powers(_STEP, _BLOCK), powers(pow(_STEP, -1, 1 << 64), _BLOCK)
        parts = [np.empty(0, np.uint64)]
        for i, j in zip(edges, edges[1:]):
            if i == j:
                continue
            low, high = int(starts[i]), int(starts[j]) if j < len(starts) else len(data)
            if high - low > len(up):
                up, down = powers(_STEP, high - low), powers(pow(_STEP, -1, 1 << 64), high - low)
            at = starts[i:j] - low
            parts.append(mix(np.add.reduceat(table[data[low:high]] * up[: high - low], at) * down[at]))
        words = np.diff(np.searchsorted(starts, offsets))
        self.sizes = words + 1
        self.h = np.full(len(starts) + len(words), _END, np.uint64)
        self.h[np.arange(len(starts)) + np.repeat(np.arange(len(words)), words)] = np.concatenate(parts)
        self.is_end = np.zeros(len(self.h), bool)
        self.is_end[np.cumsum(self.sizes) - 1] = True


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


class Grams:
    """The distinct trigrams of a chunk's tokens by shard, first word, bigram and last word. An entry is a place where
    two tokens follow each other: at[e] is the place of the first, gram[e] and pair[e] number its trigram and bigram."""

    def __init__(self, tokens: Tokens, shards: int):
        h, self.at = tokens.h, np.flatnonzero(~tokens.is_end)
        after = np.append(h, _PAD)
        first, second = h[self.at], after[self.at + 1]
        third = np.where(tokens.is_end[self.at + 1], _PAD, after[np.minimum(self.at + 2, len(h))])
        _, where, pair = np.unique(joined(first, second), return_index=True, return_inverse=True)
        a, b = first[where], second[where]
        shard = joined(a, b % np.uint64(SPREAD)) % np.uint64(shards)
        by = np.lexsort((b, a, shard))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        self.pair, self.b, a, shard = rank[pair], b[by], a[by], shard[by].astype(np.int64)
        order = np.lexsort((third, self.pair))
        pairs, third = self.pair[order], third[order]
        new = _firsts(pairs, third)
        self.gram = np.empty(len(order), np.int64)
        self.gram[order] = np.cumsum(new) - 1
        self.c, self.pair_of = third[new], pairs[new]
        heads = np.flatnonzero(_firsts(a, shard))
        self.a, self.pairs_of_a = a[heads], np.diff(np.append(heads, len(a)))
        self.grams_of_pair = np.bincount(self.pair_of, minlength=len(a))
        self.shards, self.pair_cut = np.unique(shard, return_index=True)
        self.pair_cut = np.append(self.pair_cut, len(a))
        self.gram_cut = np.searchsorted(self.pair_of, self.pair_cut)
        self.a_cut = np.searchsorted(heads, self.pair_cut)

    def requests(self, weight: np.ndarray, book: np.ndarray = _NONE):
        """(shard, blob) with the trigrams and their counts, by the weight of each entry."""
        n = np.bincount(self.gram, weight, len(self.c)).astype(np.int64)
        for i, shard in enumerate(self.shards.tolist()):
            a, p, g = (slice(c[i], c[i + 1]) for c in (self.a_cut, self.pair_cut, self.gram_cut))
            yield shard, pack(self.a[a], self.b[p], self.c[g], self.pairs_of_a[a], self.grams_of_pair[p], n[g], book=book)


class Words:
    """The distinct words of a chunk by shard; word[e] numbers those of the entries."""

    def __init__(self, first: np.ndarray, shards: int):
        keys, word = np.unique(first, return_inverse=True)
        shard = (mix(keys) % np.uint64(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        self.by, self.keys, self.word = by, keys[by], rank[word]
        self.shards, cut = np.unique(shard[by], return_index=True)
        self.cut = np.append(cut, len(by))

    def requests(self, *counts: np.ndarray, book: np.ndarray = _NONE):
        for i, shard in enumerate(self.shards.tolist()):
            s = slice(self.cut[i], self.cut[i + 1])
            yield shard, pack(self.keys[s], *(c[self.by][s] for c in counts), book=book)


def pack(*arrays: np.ndarray, book: np.ndarray = _NONE) -> bytes:
    """Arrays of counts in the smallest type and compressed; arrays of keys (unsigned) as their numbers in the sorted
    book, compressed, and the other keys as they are."""
    out = []
    for x in arrays:
        rest = b""
        if keys := x.dtype == np.uint64:
            at = np.searchsorted(book, x)
            known = np.append(book, np.uint64(0))[at] == x if len(book) else np.zeros(len(x), bool)
            known &= at < len(book)
            rest, x = x[~known].tobytes(), np.where(known, at, len(book))
        x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
        raw = zlib.compress(x.tobytes(), 1)
        out += [struct.pack("<BBII", keys, x.itemsize, len(raw), len(rest)), raw, rest]
    return b"".join(out)


def unpack(blob: bytes, book: np.ndarray = _NONE) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        keys, size, n, more = struct.unpack_from("<BBII", blob, at)
        at += 10
        x = np.frombuffer(zlib.decompress(blob[at : at + n]), f"u{size}").astype(np.int64)
        if keys:
            known = x < len(book)
            codes, x = x, np.empty(len(x), np.uint64)
            x[known] = book[codes[known]]
            x[~known] = np.frombuffer(blob, np.uint64, more // 8, at + n)
        out.append(x)
        at += n + more
    return out


def code_book(docs: DataFrame, size: int) -> np.ndarray:
    """The most frequent words of a sample of the texts, sorted: what a blob may shorten, nothing else."""

    def counted(batches):
        for batch in batches:
            tokens = Tokens(batch.column(0))
            keys, n = np.unique(tokens.h[~tokens.is_end], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(size // BOOK_BYTES + 1)) == 0)
    counts = sample.mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "key").limit(BOOK_WORDS).toArrow()  # at most BOOK_WORDS rows
    return np.sort(top.column("key").to_numpy().view(np.uint64))


def checksum(*keys: np.ndarray) -> np.ndarray:
    return np.array([sum(int(np.add.reduce(k)) for k in keys) & _MASK], np.uint64)


def _columns(batches, n: int) -> list[list]:
    out: list[list] = [[] for _ in range(n)]
    for batch in batches:
        for held, column in zip(out, batch.columns, strict=True):
            held += column.to_pylist()
    return out


def _by_shard(batches):
    shard, chunk, blob = _columns(batches, 3)
    found: dict[int, list] = {}
    for s, c, x in zip(shard, chunk, blob, strict=True):
        found.setdefault(s, []).append((c, x))
    return found


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


_SENT = {"shard": pa.int64(), "chunk": pa.int64(), "blob": pa.binary()}


def _rows(rows):
    """Batches of rows to send, of a few MB each."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size > _BLOCK * 4:
            yield _batch(held, _SENT)
            held, size = [], 0
    yield _batch(held, _SENT)


def chunks(batches):
    """(chunk, [batches of it]) of one partition's batches (text, ..., part)."""
    k, size, held, part = 0, 0, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part, low = batch.column("part")[0].as_py(), 0
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        for i, n in enumerate(lengths):
            size += n + 1
            if size >= CHUNK_BYTES:
                yield part << 32 | k, [*held, batch.slice(low, i + 1 - low)]
                k, size, held, low = k + 1, 0, [], i + 1
        if low < len(lengths):
            held.append(batch.slice(low))
    if held:
        yield part << 32 | k, held


def _texts(held: list) -> pa.Array:
    return pa.concat_arrays([b.column("text") for b in held])


def count_shard(blobs: list[tuple[int, bytes]], word_shards: int, book: np.ndarray):
    """Answers (chunk, shard's counts) and what the shard adds to its words, from all chunks' n-grams of one shard."""
    told = [unpack(x, book) for _, x in blobs]
    sizes_b, sizes_c = [len(t[1]) for t in told], [len(t[2]) for t in told]
    a, b, c, of_a, of_b, n = (np.concatenate([t[i] for t in told]) for i in range(6))
    long_a = np.repeat(a, of_a)
    keys, where, pair = np.unique(joined(long_a, b), return_index=True, return_inverse=True)
    first = long_a[where]
    long_pair = np.repeat(pair, of_b)
    _, where, gram = np.unique(joined(keys[long_pair], c), return_index=True, return_inverse=True)
    total = np.bincount(gram, n, len(where)).astype(np.int64)
    of_gram = long_pair[where]
    n2 = np.bincount(of_gram, total, len(keys)).astype(np.int64)
    d2 = np.bincount(of_gram[total > 0], minlength=len(keys))
    words, word = np.unique(first, return_inverse=True)
    n1 = np.bincount(word, n2, len(words)).astype(np.int64)
    d1 = np.bincount(word[n2 > 0], minlength=len(words))
    n2, d2, total = n2[pair], d2[pair], total[gram]
    i = j = 0
    answers = []
    for (chunk, _), t, nb, nc in zip(blobs, told, sizes_b, sizes_c, strict=True):
        answers.append((chunk, pack(n2[i : i + nb], d2[i : i + nb], total[j : j + nc], checksum(t[0], t[1], t[2]))))
        i, j = i + nb, j + nc
    seen = n1 > 0
    return answers, list(Words(words[seen], word_shards).requests(n1[seen], d1[seen], book=book))


def count_words(blobs: list[tuple[int, bytes]], book: np.ndarray):
    """Answers (chunk, counts) of one shard of words, the sum of the counts and the number of words."""
    told = [(c, unpack(x, book)) for c, x in blobs]
    parts = [t for c, t in told if c < 0]
    keys = np.concatenate([np.empty(0, np.uint64), *(t[0] for t in parts)])
    words, word = np.unique(keys, return_inverse=True)
    sums = [np.bincount(word, np.concatenate([np.empty(0, np.int64), *(t[k] for t in parts)]), len(words)).astype(np.int64) for k in (1, 2)]
    answers = []
    for chunk, t in told:
        if chunk >= 0:
            at = np.minimum(np.searchsorted(words, t[0]), max(len(words) - 1, 0))
            known = words[at] == t[0] if len(words) else np.zeros(len(t[0]), bool)
            own = [np.where(known, s[at], 0) if len(words) else np.zeros(len(t[0]), np.int64) for s in sums]
            answers.append((chunk, pack(*own, checksum(t[0]))))
    return answers, int(sums[0].sum()), len(words)


def _answers(blobs: list[bytes], n: int, check: np.ndarray) -> list[np.ndarray]:
    told = [unpack(x) for x in blobs]
    if checksum(*(t[n] for t in told)) != check:
        raise RuntimeError("the texts came in another order when they were read again")
    return [np.concatenate([np.empty(0, np.int64), *(t[i] for t in told)]).astype(np.float64) for i in range(n)]


def _weight(value: np.ndarray, has: np.ndarray) -> np.ndarray:
    """log10 of value where there is such an arc, NaN elsewhere."""
    return np.log10(value, out=np.full(len(value), np.nan), where=has)


class Automaton:
    """What of the model the texts of a chunk can reach. A state is the longest context that training saw, so its length
    (0 is the root) and the place in the text name it. Arcs and failure arcs are numbered by the n-grams of the chunk and
    weigh log10 of a probability; NaN stands for no arc.

    two[p], three[g]: arcs of the state before the last token of bigram p, trigram g; both lead to the state of the last
    two tokens. fail_one[w], fail_two[p]: failure arcs of the states of word w and bigram p to the context without its
    first token."""

    def __init__(self, tokens: Tokens, grams: Grams, words: Words, grams_told: list[bytes], words_told: list[bytes], n: int, v: int, n_texts: int):
        self.tokens, self.grams, self.words = tokens, grams, words
        n2, d2, n3 = _answers(grams_told, 3, checksum(grams.a, grams.b, grams.c))
        self.n1, d1 = _answers(words_told, 2, checksum(words.keys))
        self.count = np.full(len(tokens.h), float(n_texts))
        self.count[grams.at] = self.n1[words.word]
        one = (self.count + 0.5) / (n + 0.5 * (v + 1))
        self.root = np.log10(one)
        left1, left2 = (DISCOUNT * d / np.maximum(c, 1) for d, c in ((d1, self.n1), (d2, n2)))
        entry = np.empty(len(n2), np.int64)
        entry[grams.pair] = np.arange(len(grams.at))  # some place of each bigram
        word = words.word[entry]
        two = (n2 - DISCOUNT) / np.maximum(self.n1[word], 1) + left1[word] * one[grams.at[entry] + 1]
        entry = np.empty(len(n3), np.int64)
        entry[grams.gram] = np.arange(len(grams.at))
        after = np.minimum(entry + 1, max(len(grams.at) - 1, 0))
        pair = grams.pair[entry]
        three = (n3 - DISCOUNT) / np.maximum(n2[pair], 1) + left2[pair] * two[grams.pair[after]]
        # a trigram that ends with its text has no last token
        self.two, self.three = _weight(two, n2 > 0), _weight(three, (n3 > 0) & (grams.at[after] == grams.at[entry] + 1))
        self.fail_one, self.fail_two = _weight(left1, self.n1 > 0), _weight(left2, n2 > 0)

    def _arcs(self):
        """Lists of what each token may meet, a bounded number of tokens at a time: the root's arc and how long the context
        is to which it leads, arc and failure arc of the context of one token, those of two, and whether its text ends."""
        at, pair, gram, word = self.grams.at, self.grams.pair, self.grams.gram, self.words.word
        for low in range(0, len(self.root), _WALK):
            high = min(low + _WALK, len(self.root))
            two, fail_one, three, fail_two = np.full((4, high - low), np.nan)
            known = np.zeros(high - low, np.int64)
            i, j = np.searchsorted(at, (low, high))
            known[at[i:j] - low] = self.n1[word[i:j]] > 0
            i, j = np.searchsorted(at, (low - 1, high - 1))
            ends = at[i:j] + 1 - low
            two[ends], fail_one[ends] = self.two[pair[i:j]], self.fail_one[word[i:j]]
            e = np.arange(max(i, 1), j)
            e = e[at[e] == at[e - 1] + 1]
            three[at[e] + 1 - low], fail_two[at[e] + 1 - low] = self.three[gram[e - 1]], self.fail_two[pair[e - 1]]
            yield [x.tolist() for x in (self.root[low:high], known, two, fail_one, three, fail_two, self.tokens.is_end[low:high])]

    def walk(self) -> np.ndarray:
        """log10 of the probability of each text, in one traversal from left to right."""
        out, state, total = [], 0, 0.0
        for arcs in self._arcs():
            for root, known, two, fail_one, three, fail_two, end in zip(*arcs, strict=True):
                while state:
                    arc, fail = (three, fail_two) if state == 2 else (two, fail_one)
                    if arc == arc:
                        total += arc
                        state = 2
                        break
                    total += fail
                    state -= 1
                else:
                    total += root
                    state = known
                if end:
                    out.append(total)
                    state, total = 0, 0.0
        return np.array(out)


def score_chunk(texts: pa.Array, grams_told: list[bytes], words_told: list[bytes], shards: tuple[int, int], n: int, v: int, n_texts: int):
    """Arrays of tokens, known tokens, unigram score and score of each text of a chunk."""
    tokens = Tokens(texts)
    grams = Grams(tokens, shards[0])
    automaton = Automaton(tokens, grams, Words(tokens.h[grams.at], shards[1]), grams_told, words_told, n, v, n_texts)
    starts = np.cumsum(tokens.sizes) - tokens.sizes
    return tokens.sizes, np.add.reduceat((automaton.count > 0).astype(np.int64), starts), np.add.reduceat(automaton.root, starts), automaton.walk()


def score_all(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """docs (doc_id, text, training) with n_tokens, n_known, base_score and score by the model of the training texts,
    the number of training tokens and of distinct ones."""
    size, n_texts = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("training")).first()
    shards, word_shards = math.ceil((size + 1) / SHARD_BYTES), math.ceil((size + 1) / (4 * SHARD_BYTES))
    shared = docs.sparkSession.sparkContext.broadcast(code_book(docs, size))
    # the same columns in each reading: what is pruned can change the order of rows
    texts = docs.select("doc_id", "text", "training", F.spark_partition_id().alias("part"))

    def ask_grams(batches):
        def rows():
            for chunk, held in chunks(batches):
                tokens = Tokens(_texts(held))
                grams = Grams(tokens, shards)
                training = np.concatenate([b.column("training").to_numpy(zero_copy_only=False) for b in held])
                for shard, blob in grams.requests(np.repeat(training, tokens.sizes)[grams.at], shared.value):
                    yield shard, chunk, blob

        yield from _rows(rows())

    def ask_words(batches):
        def rows():
            for chunk, held in chunks(batches):
                tokens = Tokens(_texts(held))
                for shard, blob in Words(tokens.h[~tokens.is_end], word_shards).requests(book=shared.value):
                    yield shard, chunk, blob

        yield from _rows(rows())

    def answer_grams(batches):
        def rows():
            for shard, blobs in _by_shard(batches).items():
                answers, adds = count_shard(blobs, word_shards, shared.value)
                yield from ((shard, chunk, blob) for chunk, blob in answers)
                yield from ((to, -1, blob) for to, blob in adds)

        yield from _rows(rows())

    def answer_words(batches):
        def rows():
            for shard, blobs in _by_shard(batches).items():
                answers, n, v = count_words(blobs, shared.value)
                yield from ((shard, chunk, blob) for chunk, blob in answers)
                yield shard, -1, pack(np.array([n, v], np.int64))

        yield from _rows(rows())

    sent = "shard long, chunk long, blob binary"
    asked = texts.mapInArrow(ask_grams, sent).repartitionById(shards, F.col("shard").cast("int"))
    of_grams = stored(asked.mapInArrow(answer_grams, sent), "lm-grams")
    asked = texts.mapInArrow(ask_words, sent).union(of_grams.where("chunk < 0")).repartitionById(word_shards, F.col("shard").cast("int"))
    of_words = stored(asked.mapInArrow(answer_words, sent), "lm-words")
    n = v = 0
    for r in of_words.where("chunk < 0").toLocalIterator():  # a row a shard
        more = unpack(r["blob"])[0].tolist()
        n, v = n + more[0], v + more[1]
    n, v = n + n_texts, v + bool(n_texts)

    kind = docs.schema["doc_id"].dataType
    placed_type = f"doc_id {kind.simpleString()}, text string, training boolean, chunk long"

    def place(batches):
        for chunk, held in chunks(batches):
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.full(b.num_rows, chunk))], ["doc_id", "text", "training", "chunk"])

    placed = texts.mapInArrow(place, placed_type).select("chunk", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("shard"), F.lit(None).cast("binary").alias("blob"), "doc_id", "text", "training")
    none = [F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("training")]
    told = [t.where("chunk >= 0").select("chunk", F.lit(i).alias("kind"), "shard", "blob", *none) for i, t in enumerate((of_grams, of_words))]
    together = told[0].union(told[1]).union(placed).repartition(max(shards, 1), "chunk").sortWithinPartitions("chunk", "kind", "shard")

    def score(batches):
        def flush(blobs, held):
            table = pa.Table.from_batches(held).combine_chunks()
            column = lambda name: pa.concat_arrays(table.column(name).chunks)
            found = score_chunk(column("text"), blobs[0], blobs[1], (shards, word_shards), n, v, n_texts)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays(
                [column("doc_id"), column("training"), *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))],
                ["doc_id", "training", "n_tokens", "n_known", "base_score", "score"],
            )

        at, blobs, held = None, ([], []), []
        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            cuts = [*np.flatnonzero(_firsts(chunk)).tolist(), len(chunk)]
            for i, j in zip(cuts, cuts[1:]):
                if chunk[i] != at:
                    if held:
                        yield flush(blobs, held)
                    at, blobs, held = chunk[i], ([], []), []
                own = batch.slice(i, j - i)
                kinds = own.column("kind").to_numpy()
                m = int(np.searchsorted(kinds, 2))
                for k, x in zip(kinds[:m].tolist(), own.column("blob").slice(0, m).to_pylist(), strict=True):
                    blobs[k].append(x)
                if m < len(kinds):
                    held.append(own.slice(m))
        if held:
            yield flush(blobs, held)

    out = f"doc_id {kind.simpleString()}, training boolean, n_tokens long, n_known long, base_score double, score double"
    return together.mapInArrow(score, out), n, v
