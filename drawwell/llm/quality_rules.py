"""Quality rules: plain text measures, and the divergence of a document's histograms from those of its language.

Two histograms are taken of a document: characters by class, and the common words of the supported languages (all
other words as one bin). Each is compared with the pooled histogram of all documents of the same language by the
Jensen-Shannon distance (base 2, so between 0 and 1). A document is rejected if either distance passes its limit;
texts that are too short to have a meaningful histogram pass. Everything is DataFrame expressions, and a document's
measures are made inside its own row: only one row per language is shuffled.

Defined cases: a null or empty text has no words and fails the base rules; a null or rare language (fewer than
MIN_REFERENCE_WORDS words in all) is compared with the pool of all documents; repeated rows are judged one by one;
an empty table gives an empty result; other columns play no part. 3-word windows are compared by their words.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawwell.llm.common import let, stored, table

#: Frequent function words of English, French, German and Spanish.
COMMON_WORDS = (
    "a and are as at be by for from he in is it of on or that the this to was with "
    "au ce dans de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "als auch auf das dem den der die ein eine er ich im ist mit nicht sich sie sind und von zu "
    "al como con del el es esta las lo los más no para por se su una y"
).split()

#: Character classes as regular expressions. White space comes first, and all other characters, lower case for the
#: most part, are the last class.
CHAR_CLASSES = (r"\p{Lu}", r"\p{Nd}", r"[.,;:!?'\x22()-]", r"[#*$%&|<>@=+_/\\^~{}\[\]\x60]")
N_CLASSES = len(CHAR_CLASSES) + 2

SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MIN_CHARS = 200
MIN_REFERENCE_WORDS = 2000
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.45
#: Languages beyond which the references are joined by a shuffle instead of a broadcast (about 1 KB each).
MAX_BROADCAST_LANGUAGES = 10_000


#: Words up to which 48 bits of a window's hash and its place share one long.
PACKED_WORDS = 1 << 16


def repeated_window_words(words: Column, width: int = 3, hashed=F.xxhash64) -> Column:
    """Words that lie in a window of `width` words found twice or more in the same array of words.

    Windows are sorted by hash, so that equal ones are neighbours; then by place, to add up what they cover. In all but
    very long texts the place stands in the last bits of the hash, since longs sort much faster than structs do. Hashes
    only find candidates: neighbours of one hash are compared word by word, and if any two differ, all windows of the
    text are sorted by their words instead.
    """

    def windows(w: Column) -> Column:
        return F.slice(w, 1, F.greatest(F.size(w) - (width - 1), F.lit(0)))

    def hash_of(w: Column, x: Column, i: Column) -> Column:
        return hashed(x, *(w[i + j] for j in range(1, width)))

    def neighbours(s: Column, key) -> Column:
        return F.filter(s, lambda x, i: key(F.get(s, i + 1)).eqNullSafe(key(x)) | key(F.get(s, i - 1)).eqNullSafe(key(x)))

    def by_words(w: Column) -> Column:
        whole = lambda x, i: F.struct(F.array(x, *(w[i + j] for j in range(1, width))).alias("h"), i.alias("i"))
        structs = F.array_sort(F.transform(windows(w), whole))
        return F.transform(let(structs, lambda s: neighbours(s, lambda x: x["h"])), lambda x: x["i"])

    def checked(w: Column, found: Column, key, place) -> Column:
        """Places of the windows found, if those of one key have the same words."""
        differ = lambda i, j: ~F.array(*(w[i + k] == w[j + k] for k in range(width))).eqNullSafe(F.array(*[F.lit(True)] * width))
        collide = lambda s: F.filter(s, lambda x, i: key(F.get(s, i + 1)).eqNullSafe(key(x)) & differ(place(x), place(F.get(s, i + 1))))
        return let(found, lambda s: F.when(F.size(collide(s)) == 0, F.transform(s, place)).otherwise(by_words(w)))

    def packed(w: Column) -> Column:
        mask = F.lit(PACKED_WORDS - 1).cast("long")
        longs = F.sort_array(F.transform(windows(w), lambda x, i: hash_of(w, x, i).bitwiseAND(F.lit(-PACKED_WORDS).cast("long")).bitwiseOR(i.cast("long"))))
        key = lambda x: F.shiftright(x, 16)
        return checked(w, let(longs, lambda s: neighbours(s, key)), key, lambda x: x.bitwiseAND(mask).cast("int"))

    def paired(w: Column) -> Column:
        structs = F.array_sort(F.transform(windows(w), lambda x, i: F.struct(hash_of(w, x, i).alias("h"), i.alias("i"))))
        return checked(w, let(structs, lambda s: neighbours(s, lambda x: x["h"])), lambda x: x["h"], lambda x: x["i"])

    def covered(at: Column) -> Column:
        # each window adds what the one before it doesn't cover
        none = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"))
        return F.aggregate(F.sort_array(at), none, step, lambda acc: acc["n"])

    return let(words, lambda w: covered(F.when(F.size(w) <= PACKED_WORDS, packed(w)).otherwise(paired(w))))


def text_measures(text: Column, words: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text column that is never null."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_window_words(words),
    }


def char_histogram(text: Column, words: Column) -> Column:
    """Characters of a text by class, as an array of counts."""
    total = F.char_length(text).cast("long")
    inside = F.char_length(F.array_join(words, "")).cast("long")
    counts = [F.regexp_count(text, F.lit(c)).cast("long") for c in CHAR_CLASSES]
    return F.array(total - inside, *counts, inside - sum(counts, F.lit(0).cast("long")))


def _slots() -> list[str]:
    """The common words in an open table: each stands where crc32 modulo its size puts it, alone."""
    for size in range(len(COMMON_WORDS), 1 << 16):
        if len({zlib.crc32(w.encode()) % size for w in COMMON_WORDS}) == len(COMMON_WORDS):
            table = [""] * size
            for w in COMMON_WORDS:
                table[zlib.crc32(w.encode()) % size] = w
            return table
    raise ValueError("no table without collisions")


SLOTS = _slots()


def word_histogram(text: Column) -> Column:
    """(slot, n) of each common word that a text holds, in order."""
    slots = F.array(*map(F.lit, SLOTS))
    slot = lambda w: (F.crc32(w.cast("binary")) % len(SLOTS)).cast("int")
    words = F.filter(F.split(F.lower(text), r"\P{L}+"), lambda w: F.get(slots, slot(w)) == w)
    places = F.sort_array(F.transform(F.filter(words, lambda w: w != ""), slot))

    def counts(p: Column) -> Column:
        first = lambda k: F.array_position(p, k)
        entry = lambda u: lambda k, i: F.struct(k.alias("k"), (F.coalesce(first(F.get(u, i + 1)), F.size(p) + 1) - first(k)).cast("long").alias("n"))
        return let(F.array_distinct(p), lambda u: F.transform(u, entry(u)))

    return let(places, counts)


def _part(p: Column, q: Column) -> Column:
    """What one bin adds to twice the divergence of p and q."""
    one = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return one(p) + one(q)


def class_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; 0 if either is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def distance(t: Column) -> Column:
        parts = F.zip_with(counts, reference, lambda a, b: _part(a / t["a"], b / t["b"]))
        return F.when((t["a"] > 0) & (t["b"] > 0), F.sqrt(F.greatest(total(parts) / 2, F.lit(0.0)))).otherwise(0.0)

    return let(F.struct(total(counts).alias("a"), total(reference).alias("b")), distance)


def word_distance(entries: Column, n_words: Column, reference: Column, ref_n: Column) -> Column:
    """The same of common words and one bin for all others. A bin that the document lacks adds its whole share of the
    reference, so only the document's own bins are walked."""
    start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))

    def step(acc: Column, e: Column) -> Column:
        p, q = e["n"] / n_words, F.get(reference, e["k"]) / ref_n
        return F.struct((acc["d"] + _part(p, q)).alias("d"), (acc["p"] + p).alias("p"), (acc["q"] + q).alias("q"))

    def finish(acc: Column) -> Column:
        known = F.aggregate(reference, F.lit(0.0), lambda s, v: s + v) / ref_n
        other_p, other_q = F.greatest(1 - acc["p"], F.lit(0.0)), F.greatest(1 - known, F.lit(0.0))
        return F.sqrt(F.greatest((acc["d"] + (known - acc["q"]) + _part(other_p, other_q)) / 2, F.lit(0.0)))

    return F.when((n_words > 0) & (ref_n > 0), F.aggregate(entries, start, step, finish)).otherwise(0.0)


def language_references(features: DataFrame) -> DataFrame:
    """One row per language (null: the pool of all) with summed histograms and its number of words."""
    chars = F.array(*(F.sum(F.col("chars")[i]) for i in range(N_CLASSES))).alias("ref_chars")
    sums = [chars, F.sum("n_words").alias("ref_n")]
    totals = features.groupBy("lang").agg(*sums).where(F.col("lang").isNotNull() & (F.col("ref_n") >= MIN_REFERENCE_WORDS))
    totals = totals.unionByName(features.agg(*sums).withColumn("lang", F.lit(None).cast("string")))
    by_lang = features.select("lang", F.explode("words").alias("e")).groupBy("lang", "e.k").agg(F.sum("e.n").alias("n"))
    by_lang = by_lang.where("lang IS NOT NULL").unionByName(by_lang.groupBy(F.lit(None).cast("string").alias("lang"), "k").agg(F.sum("n").alias("n")))
    slots = F.array(*(F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)) for k in range(len(SLOTS))))
    words = by_lang.groupBy("lang").agg(slots.alias("ref_words"))
    joined = totals.join(words.withColumnRenamed("lang", "word_lang"), F.col("lang").eqNullSafe(F.col("word_lang")), "left")
    none = F.array_repeat(F.lit(0).cast("long"), len(SLOTS))
    return joined.select(F.col("lang").alias("ref_lang"), "ref_chars", "ref_n", F.coalesce("ref_words", none).alias("ref_words"))


def judge_quality(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, both distances, base_failed and kept of every row of docs (doc_id, text, lang)."""
    texts = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("split", F.array_remove(F.split("text", SPACES), ""))
    text, words = F.col("text"), F.col("split")
    measures = [c.alias(name) for name, c in text_measures(text, words).items()]
    features = stored(texts.select("doc_id", "lang", *measures, char_histogram(text, words).alias("chars"), word_histogram(text).alias("words")), "quality")
    references = stored(language_references(features), "quality-references")
    if references.count() <= MAX_BROADCAST_LANGUAGES:
        references = F.broadcast(references)
    own = references.where("ref_lang IS NOT NULL")
    names = ("ref_chars", "ref_words", "ref_n")
    pool = references.where("ref_lang IS NULL").select(*(F.col(n).alias(f"pool_{n}") for n in names))
    joined = features.join(own, F.col("lang") == F.col("ref_lang"), "left").join(F.broadcast(pool), F.lit(True))
    ref_chars, ref_words, ref_n = (F.coalesce(n, f"pool_{n}") for n in names)
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda s, v: s + v)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = joined.select(
        *features.columns,
        base_failed.alias("base_failed"),
        F.when(n_chars >= MIN_CHARS, class_distance(F.col("chars"), ref_chars)).otherwise(0.0).alias("class_distance"),
        F.when(F.col("n_words") >= MIN_WORDS, word_distance(F.col("words"), F.col("n_words"), ref_words, ref_n)).otherwise(0.0).alias("word_distance"),
    )
    passed = (F.col("class_distance") <= MAX_CLASS_DISTANCE) & (F.col("word_distance") <= MAX_WORD_DISTANCE)
    return judged.drop("lang", "chars", "words").withColumn("kept", ~F.col("base_failed") & passed)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every whole document."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    distances = [F.round(c, 6).alias(c) for c in ("class_distance", "word_distance")]
    return judge_quality(table(spark, sf_dir, "documents")).select(*names, *distances)
