"""Queries over the test tables, one or more for each operator, with the same in SQL."""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawwell.functions.layout import assign_shards, index_entries, metadata_columns, metadata_json, record_length, shard_name
from drawwell.operators import active as A
from drawwell.operators import sampling
from drawwell.sources.cache import load_cache, mismatched, record_hash, write_cache
from drawwell.sources.inputs import FrameSource
from drawwell.sources.shared import shared_dir
from drawwell.types import ReaderConfig, WriterConfig

META = ["doc_id", "lang", "n_chars", "source"]
SEED = 42
QUIET = WriterConfig(show_progress=False)
SHARD_BYTES = 1 << 18
COLUMNS = ["cache_id", "sample_id", *META, "weight", A.POS]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", "lang", "n_chars", "source", F.col("text").cast("binary").alias("payload"))


def _samples(spark, sf_dir, *columns) -> DataFrame:
    """Rows with ids in the order of doc_id. What queries need of a payload is made first, so no payload is sorted."""
    docs = _docs(spark, sf_dir).select(*META, *columns)
    return A.dense_index(docs, ["doc_id", *(c for c in META if c != "doc_id")], "sample_id")


def _single(spark, sf_dir) -> DataFrame:
    return A.active_table([_samples(spark, sf_dir)], META)


def _by_lang(spark, sf_dir) -> list[DataFrame]:
    docs = _docs(spark, sf_dir).drop("payload")
    langs = docs.select("lang").distinct().orderBy(F.asc_nulls_last("lang")).collect()  # a row a cache; nulls last, as in the SQL
    return [A.dense_index(docs.where(F.col("lang").eqNullSafe(F.lit(r["lang"]))), ["doc_id"], "sample_id") for r in langs]


def _balanced(spark, sf_dir) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("l_id"), "quality")
    joined = _single(spark, sf_dir).join(labels, F.col("doc_id") == F.col("l_id")).drop("l_id")
    return A.ordered(A.class_balanced(joined, "quality").drop("quality"))


def _at(df: DataFrame) -> DataFrame:
    return df.select("seq", "cache_id", "sample_id")


def _joined(draws: DataFrame, table: DataFrame) -> DataFrame:
    return _at(draws.join(table.select(A.POS, "cache_id", "sample_id"), A.POS))


def active_table_full(spark, sf_dir):
    return _single(spark, sf_dir)


def active_table_multi_cache(spark, sf_dir):
    return A.active_table(_by_lang(spark, sf_dir), META)


def active_head(spark, sf_dir):
    return A.ordered(A.head(_single(spark, sf_dir), 100))


def active_tail(spark, sf_dir):
    return A.ordered(A.tail(_single(spark, sf_dir), 100))


def active_filter(spark, sf_dir):
    return A.ordered(_single(spark, sf_dir).where((F.col("lang") == "en") & (F.col("n_chars") > 1000)))


def active_sort_desc(spark, sf_dir):
    return A.ordered(_single(spark, sf_dir), [F.desc("n_chars"), "doc_id"]).select(COLUMNS)


def active_concat_duplicates(spark, sf_dir):
    table = _single(spark, sf_dir)
    first, last = A.head(table, 50), A.tail(table, 30)
    return A.concat(first, last, first).select(COLUMNS)


def class_balance_weights(spark, sf_dir):
    return A.class_balanced(_single(spark, sf_dir), "lang").select(COLUMNS)


def ohem_weights_with_extras(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("l_id"), "quality")
    table = _single(spark, sf_dir).join(labels, F.col("doc_id") == F.col("l_id"), "left")
    weight = F.when(F.col("quality") == 0, F.lit(4.0)).when(F.col("quality") == 1, F.lit(1.0)).otherwise(F.lit(0.5))
    return table.withColumn("weight", weight).withColumn("note", F.lit(None).cast("string")).select(*COLUMNS, F.coalesce("quality", F.lit(-1)).alias("quality"), "note")


def _window(start, length, keep=None):
    def query(spark, sf_dir):
        table = _single(spark, sf_dir)
        table = A.ordered(A.head(table, keep)) if keep else table
        return _joined(sampling.sequential(spark, start, length, table.count()), table)

    return query


def sequential_wrap_population(spark, sf_dir):
    """A window over the whole table that starts 30 rows before its end."""
    table = _single(spark, sf_dir)
    n = table.count()
    return _joined(sampling.sequential(spark, n - 30, 60, n), table)


def sequential_past_population(spark, sf_dir):
    """A window 50 rows longer than the whole table."""
    table = _single(spark, sf_dir)
    n = table.count()
    return _joined(sampling.sequential(spark, 0, n + 50, n), table)


def sequential_duplicates(spark, sf_dir):
    table = active_concat_duplicates(spark, sf_dir)
    return _joined(sampling.sequential(spark, 100, 200, table.count()), table)


def _uniform(start, length):
    def query(spark, sf_dir):
        table = _single(spark, sf_dir)
        return _joined(sampling.uniform_draws(spark, SEED, start, length, table.count()), table)

    return query


def weighted_draws(spark, sf_dir):
    table = _balanced(spark, sf_dir)
    return _joined(sampling.weighted_draws(table, SEED, 0, 2 * table.count()), table)


def weighted_draws_duplicates(spark, sf_dir):
    """Draws over the whole balanced table twice over."""
    table = _balanced(spark, sf_dir)
    table = A.concat(table, table)
    return _joined(sampling.weighted_draws(table, SEED, 0, 2 * table.count()), table)


def draw_histogram(spark, sf_dir):
    return weighted_draws(spark, sf_dir).groupBy("cache_id", "sample_id").agg(F.count("*").alias("n_draws"))


def cache_offsets(spark, sf_dir):
    table = active_table_multi_cache(spark, sf_dir)
    return table.groupBy("cache_id").agg(F.min(A.POS).alias("cache_offset"), F.count("*").alias("sample_count"))


def locate_physical(spark, sf_dir):
    offsets = F.broadcast(cache_offsets(spark, sf_dir))  # a row a cache
    inside = (F.col("physical") >= F.col("cache_offset")) & (F.col("physical") < F.col("cache_offset") + F.col("sample_count"))
    total = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    found = spark.range(total).select(F.col("id").alias("physical")).join(offsets, inside)
    return found.select("physical", "cache_id", (F.col("physical") - F.col("cache_offset")).alias("sample_id"))


def record_lengths(spark, sf_dir):
    return _samples(spark, sf_dir, record_length(META).alias("byte_len")).select("sample_id", "byte_len")


def shard_assignment(spark, sf_dir):
    return assign_shards(record_lengths(spark, sf_dir), SHARD_BYTES)


def index_table(spark, sf_dir):
    return index_entries(shard_assignment(spark, sf_dir)).select("sample_id", "shard_id", "offset", "byte_len", shard_name().alias("shard"))


def shard_summary(spark, sf_dir):
    return shard_assignment(spark, sf_dir).groupBy("shard_id").agg(F.count("*").alias("n_samples"), F.sum("byte_len").alias("byte_len"))


def payload_sha256(spark, sf_dir):
    return _samples(spark, sf_dir, F.sha2("payload", 256).alias("payload_sha256")).select("sample_id", "payload_sha256")


def manifest_summary(spark, sf_dir):
    kinds = {"documents": "text", "pages": "html", "conversations": "text"}
    out = None
    for name, text in kinds.items():
        t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        one = t.agg(F.lit(name).alias("source_name"), F.count("*").alias("sample_count"), F.sum(F.octet_length(text)).alias("payload_bytes"))
        out = one if out is None else out.unionByName(one)
    return out


def _fresh(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/caches-{uuid.uuid4().hex}"


def _dataset(spark, sf_dir, shuffle: bool):
    from drawwell.runtime import CachedDataset

    done = write_cache(spark, FrameSource("documents", _docs(spark, sf_dir), ("doc_id",)), _fresh(spark), QUIET)
    return CachedDataset(spark, [done.path], ReaderConfig(seed=SEED, shuffle=shuffle))


def materialise_samples(spark, sf_dir):
    found = _dataset(spark, sf_dir, False).window()
    return found.select("seq", "sample_id", *META, F.sha2("payload", 256).alias("payload_sha256"))


def materialise_weighted(spark, sf_dir):
    """Write a cache, balance its classes, and read a weighted epoch with payloads."""
    data = _dataset(spark, sf_dir, True)
    data.update_metadata(A.class_balanced(data.get_metadata(), "lang"))
    return data.window().select("seq", "sample_id", *META, F.sha2("payload", 256).alias("payload_sha256"))


def reject_unknown_identity(spark, sf_dir):
    table = _single(spark, sf_dir)
    bad = F.when(F.col("doc_id") % 10 == 3, F.col("sample_id") + 1_000_000_000).otherwise(F.col("sample_id"))
    counts = table.groupBy(F.col("cache_id").alias("cache")).agg(F.count("*").alias("n"))
    return A.unknown_identities(table.withColumn("sample_id", bad), counts).select("cache_id", "sample_id", A.POS)


def _planted(spark, sf_dir):
    table, k = _single(spark, sf_dir), F.col("doc_id")
    return table.withColumns({
        "cache_id": F.when(k % 7 == 1, F.lit(None)).when(k % 7 == 2, F.lit(-1)).otherwise(F.col("cache_id")),
        "sample_id": F.when(k % 11 == 1, F.lit(None)).when(k % 11 == 2, -F.col("sample_id") - 1).otherwise(F.col("sample_id")),
        "weight": F.when(k % 13 == 1, F.lit(None)).when(k % 13 == 2, F.lit(0.0)).when(k % 13 == 3, F.lit(float("nan"))).when(k % 13 == 4, F.lit(float("inf"))).otherwise(F.col("weight")),
    })


def reject_null_or_negative_ids(spark, sf_dir):
    return A.violations(_planted(spark, sf_dir)).select("n_rows", "cache_id_null", "sample_id_null", "cache_id_negative", "sample_id_negative")


def reject_bad_weights(spark, sf_dir):
    return A.violations(_planted(spark, sf_dir)).select("weight_null", "weight_bad", "first_bad_weight")


def embedded_mismatch(spark, sf_dir):
    rows = _samples(spark, sf_dir, "payload").withColumn("record_sha256", record_hash(META))
    return mismatched(rows.withColumn("lang", F.when(F.col("sample_id") == 5, F.lit("xx")).otherwise(F.col("lang"))), META).select("sample_id")


def embedded_mismatches(spark, sf_dir):
    """Rows of a written cache whose metadata was altered, found by the hashes stored with them."""
    done = write_cache(spark, FrameSource("documents", _docs(spark, sf_dir), ("doc_id",)), _fresh(spark), QUIET)
    _, rows = load_cache(spark, done.path)
    altered = F.when(F.col("sample_id") % 7 == 5, F.concat("lang", F.lit("x"))).otherwise(F.col("lang"))
    return mismatched(rows.withColumn("lang", altered), META).select("sample_id")


def sorted_order(spark, sf_dir):
    """An active table that was only sorted emits in that order."""
    data = _dataset(spark, sf_dir, False)
    data.update_metadata(data.get_metadata().orderBy(F.desc("n_chars"), "doc_id"))
    return data.window().select("seq", "sample_id", *META)


def metadata_json_round_trip(spark, sf_dir):
    text = _docs(spark, sf_dir).select("doc_id", metadata_json(META).alias("json"))
    back = metadata_columns(F.col("json"), "doc_id bigint, lang string, n_chars bigint, source string")
    return text.select(F.col("doc_id").alias("id"), back.alias("m")).select("id", "m.*")


def schema_agreement(spark, sf_dir):
    base, pages = _fresh(spark), spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    done = write_cache(spark, [FrameSource("documents", _docs(spark, sf_dir), ("doc_id",)), FrameSource("pages", pages, ("page_id",))], base)
    from drawwell.runtime import CachedDataset

    try:
        CachedDataset(spark, [d.path for d in done], ReaderConfig(seed=1))
        said = "agreed"
    except ValueError as e:
        said = str(e)
    return spark.createDataFrame([(said,)], "message string")


def write_results_partial_failure(spark, sf_dir):
    good, bad = _docs(spark, sf_dir), _docs(spark, sf_dir).withColumn("lang", F.lit(None).cast("string"))
    done = write_cache(spark, [FrameSource("bad", bad, ("doc_id",)), FrameSource("good", good, ("doc_id",))], _fresh(spark))
    return spark.createDataFrame([(d.source_name, hasattr(d, "path")) for d in done], "source_name string, written boolean")


def embeddings_round_trip(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    packed = rows.select("vec_id", F.col("label").cast("long").alias("label"), F.to_json("embedding").cast("binary").alias("payload"))
    done = write_cache(spark, FrameSource("embeddings", packed, ("vec_id",)), _fresh(spark))
    back = spark.read.parquet(f"{PurePosixPath(done.path)}/samples" if "://" not in done.path else f"{done.path}/samples")
    return back.select("sample_id", "vec_id", "label", F.size(F.from_json(F.col("payload").cast("string"), "array<float>")).alias("n_values"))


QUERIES = {f.__name__: f for f in (
    active_table_full, active_table_multi_cache, active_head, active_tail, active_filter, active_sort_desc,
    active_concat_duplicates, class_balance_weights, ohem_weights_with_extras, sequential_duplicates, weighted_draws,
    sequential_wrap_population, sequential_past_population, weighted_draws_duplicates,
    draw_histogram, cache_offsets, locate_physical, record_lengths, shard_assignment, index_table, shard_summary,
    payload_sha256, manifest_summary, materialise_samples, materialise_weighted, reject_unknown_identity,
    reject_null_or_negative_ids, reject_bad_weights, embedded_mismatch, schema_agreement,
    embedded_mismatches, sorted_order, metadata_json_round_trip,
    write_results_partial_failure, embeddings_round_trip,
)} | {
    "sequential_window": _window(10, 50), "sequential_wrap": _window(70, 60, 100),
    "sequential_longer_than_population": _window(0, 250, 100),
    "uniform_draws": _uniform(0, 1000), "uniform_draws_third_window": _uniform(2000, 1000),
}

_D = "D AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS sample_id, doc_id, lang, n_chars, source, text FROM documents)"
_T = f"WITH {_D}, A AS (SELECT CAST(0 AS BIGINT) AS cache_id, sample_id, doc_id, lang, n_chars, source, CAST(1.0 AS DOUBLE) AS weight, sample_id AS active_pos FROM D)"
_KEEP = "cache_id, sample_id, doc_id, lang, n_chars, source, weight"
_POS = "row_number() OVER (ORDER BY {}) - 1 AS active_pos"
_LEN = "CAST(8 + strlen(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source})) + strlen(text) AS BIGINT)"
_S = f"""WITH RECURSIVE {_D}, L AS (SELECT sample_id, {_LEN} AS byte_len FROM D),
P AS (SELECT sample_id, byte_len, CAST(0 AS BIGINT) AS shard_id, byte_len AS used FROM L WHERE sample_id = 0
UNION ALL SELECT l.sample_id, l.byte_len, CASE WHEN p.used + l.byte_len > {SHARD_BYTES} THEN p.shard_id + 1 ELSE p.shard_id END,
CASE WHEN p.used + l.byte_len > {SHARD_BYTES} THEN l.byte_len ELSE p.used + l.byte_len END FROM P p JOIN L l ON l.sample_id = p.sample_id + 1)"""
_HASH = f"CAST(concat('0x', substr(sha256('{SEED}:' || CAST(k AS VARCHAR)), 1, 15)) AS HUGEINT)"
_M = f"""WITH M AS (SELECT dense_rank() OVER (ORDER BY lang) - 1 AS cache_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS sample_id,
doc_id, lang, n_chars, source, CAST(1.0 AS DOUBLE) AS weight, row_number() OVER (ORDER BY lang, doc_id) - 1 AS active_pos FROM documents)"""


def _drawn(table: str, draws: str) -> str:
    """Weighted draws over a table (cache_id, sample_id, weight, active_pos)."""
    return f"""{table}, N AS (SELECT count(*) AS n, max(weight) AS w FROM B),
Q AS (SELECT *, greatest(1, CAST(floor(weight / w * pow(2, least(40, 62 - greatest(1, ceil(log2(n)))))) AS BIGINT)) AS q FROM B, N),
R AS (SELECT *, sum(q) OVER (ORDER BY active_pos) AS hi FROM Q), T AS (SELECT max(hi) AS total FROM R),
X AS (SELECT k, ({_HASH} * total) // 1152921504606846976 AS x FROM (SELECT unnest(range({draws})) AS k), T)
SELECT k AS seq, cache_id, sample_id FROM X JOIN R ON x >= hi - q AND x < hi"""


_B = f"""{_T}, C AS (SELECT quality, count(*) AS n FROM A JOIN labels USING (doc_id) GROUP BY quality),
B AS (SELECT cache_id, sample_id, 1.0 / C.n AS weight, row_number() OVER (ORDER BY active_pos) - 1 AS active_pos FROM A JOIN labels USING (doc_id) JOIN C USING (quality))"""
_TWICE = _B.replace("\nB AS (", "\nB0 AS (") + """,
B AS (SELECT cache_id, sample_id, weight, row_number() OVER (ORDER BY s, active_pos) - 1 AS active_pos FROM (SELECT 0 AS s, * FROM B0 UNION ALL SELECT 1, * FROM B0))"""
_DRAWS = _drawn(_B, "0, 2 * (SELECT n FROM N)")
_DUP = f"""{_T}, U AS (SELECT 0 AS s, * FROM A WHERE active_pos < 50 UNION ALL SELECT 1, * FROM A WHERE active_pos >= (SELECT count(*) - 30 FROM A)
UNION ALL SELECT 2, * FROM A WHERE active_pos < 50), V AS (SELECT {_KEEP}, row_number() OVER (ORDER BY s, active_pos) - 1 AS active_pos FROM U)"""
_SEQ = "SELECT k AS seq, cache_id, sample_id FROM (SELECT unnest(range({n})) AS k) JOIN {t} ON active_pos = (k + {s}) % {m}"
_PLANT = f"""{_T}, X AS (SELECT CASE WHEN doc_id % 7 = 1 THEN NULL WHEN doc_id % 7 = 2 THEN -1 ELSE cache_id END AS cache_id,
CASE WHEN doc_id % 11 = 1 THEN NULL WHEN doc_id % 11 = 2 THEN -sample_id - 1 ELSE sample_id END AS sample_id,
CASE WHEN doc_id % 13 = 1 THEN NULL WHEN doc_id % 13 = 2 THEN 0.0 WHEN doc_id % 13 = 3 THEN 'nan'::DOUBLE WHEN doc_id % 13 = 4 THEN 'inf'::DOUBLE ELSE weight END AS weight, active_pos FROM A)"""


def _uniform_sql(start: int, n: int) -> str:
    return f"""{_T}, N AS (SELECT count(*) AS n FROM A), X AS (SELECT k - {start} AS seq, CAST(({_HASH} * n) // 1152921504606846976 AS BIGINT) AS p FROM (SELECT unnest(range({start}, {start + n})) AS k), N)
SELECT seq, cache_id, sample_id FROM X JOIN A ON active_pos = p"""


ORACLES = {
    "active_table_full": f"{_T} SELECT * FROM A",
    "active_table_multi_cache": f"{_M} SELECT * FROM M",
    "active_head": f"{_T} SELECT * FROM A WHERE active_pos < 100",
    "active_tail": f"{_T} SELECT {_KEEP}, {_POS.format('active_pos')} FROM A WHERE active_pos >= (SELECT count(*) - 100 FROM A)",
    "active_filter": f"{_T} SELECT {_KEEP}, {_POS.format('active_pos')} FROM A WHERE lang = 'en' AND n_chars > 1000",
    "active_sort_desc": f"{_T} SELECT {_KEEP}, {_POS.format('n_chars DESC, doc_id')} FROM A",
    "active_concat_duplicates": f"{_DUP} SELECT * FROM V",
    "class_balance_weights": f"{_T} SELECT cache_id, sample_id, doc_id, lang, n_chars, source, 1.0 / count(*) OVER (PARTITION BY lang) AS weight, active_pos FROM A",
    "ohem_weights_with_extras": f"{_T} SELECT cache_id, sample_id, A.doc_id, lang, n_chars, source, CAST(CASE WHEN quality = 0 THEN 4.0 WHEN quality = 1 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS weight, active_pos, coalesce(quality, -1) AS quality, CAST(NULL AS VARCHAR) AS note FROM A LEFT JOIN labels ON A.doc_id = labels.doc_id",
    "sequential_window": f"{_T} " + _SEQ.format(n=50, t="A", s=10, m="(SELECT count(*) FROM A)"),
    "sequential_wrap": f"{_T} " + _SEQ.format(n=60, t="A", s=70, m=100),
    "sequential_longer_than_population": f"{_T} " + _SEQ.format(n=250, t="A", s=0, m=100),
    "sequential_duplicates": f"{_DUP} " + _SEQ.format(n=200, t="V", s=100, m=130),
    "uniform_draws": _uniform_sql(0, 1000),
    "uniform_draws_third_window": _uniform_sql(2000, 1000),
    "sequential_wrap_population": f"{_T} " + _SEQ.format(n=60, t="A", s="(SELECT count(*) - 30 FROM A)", m="(SELECT count(*) FROM A)"),
    "sequential_past_population": f"{_T} " + _SEQ.format(n="(SELECT count(*) + 50 FROM A)", t="A", s=0, m="(SELECT count(*) FROM A)"),
    "weighted_draws": _DRAWS,
    "weighted_draws_duplicates": _drawn(_TWICE, "0, 2 * (SELECT n FROM N)"),
    "draw_histogram": f"SELECT cache_id, sample_id, count(*) AS n_draws FROM ({_DRAWS}) GROUP BY ALL",
    "cache_offsets": f"{_M} SELECT cache_id, min(active_pos) AS cache_offset, count(*) AS sample_count FROM M GROUP BY cache_id",
    "locate_physical": f"{_M} SELECT active_pos AS physical, cache_id, sample_id FROM M",
    "record_lengths": f"WITH {_D} SELECT sample_id, {_LEN} AS byte_len FROM D",
    "shard_assignment": f"{_S} SELECT sample_id, byte_len, shard_id FROM P",
    "index_table": f"{_S} SELECT sample_id, shard_id, used - byte_len AS \"offset\", byte_len, printf('%06d.bin', shard_id) AS shard FROM P",
    "shard_summary": f"{_S} SELECT shard_id, count(*) AS n_samples, CAST(sum(byte_len) AS BIGINT) AS byte_len FROM P GROUP BY shard_id",
    "payload_sha256": f"WITH {_D} SELECT sample_id, sha256(text) AS payload_sha256 FROM D",
    "manifest_summary": " UNION ALL ".join(f"SELECT '{t}' AS source_name, count(*) AS sample_count, CAST(sum(strlen({c})) AS BIGINT) AS payload_bytes FROM {t}" for t, c in (("documents", "text"), ("pages", "html"), ("conversations", "text"))),
    "materialise_samples": f"WITH {_D} SELECT sample_id AS seq, sample_id, doc_id, lang, n_chars, source, sha256(text) AS payload_sha256 FROM D",
    "materialise_weighted": "SELECT Z.seq, Z.sample_id, doc_id, lang, n_chars, source, payload_sha256 FROM (" + _drawn(f"{_T}, B AS (SELECT cache_id, sample_id, 1.0 / count(*) OVER (PARTITION BY lang) AS weight, active_pos FROM A)", "0, (SELECT n FROM N)") + ") Z JOIN (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS sample_id, doc_id, lang, n_chars, source, sha256(text) AS payload_sha256 FROM documents) Y ON Z.sample_id = Y.sample_id",
    "reject_unknown_identity": f"{_T} SELECT cache_id, sample_id + 1000000000 AS sample_id, active_pos FROM A WHERE doc_id % 10 = 3",
    "reject_null_or_negative_ids": f"{_PLANT} SELECT count(*) AS n_rows, count(*) FILTER (cache_id IS NULL) AS cache_id_null, count(*) FILTER (sample_id IS NULL) AS sample_id_null, count(*) FILTER (cache_id < 0) AS cache_id_negative, count(*) FILTER (sample_id < 0) AS sample_id_negative FROM X",
    "reject_bad_weights": f"{_PLANT}, Y AS (SELECT *, weight <= 0 OR isnan(weight) OR isinf(weight) AS bad FROM X) SELECT count(*) FILTER (weight IS NULL) AS weight_null, count(*) FILTER (bad) AS weight_bad, min(active_pos) FILTER (bad) AS first_bad_weight FROM Y",
    "embedded_mismatch": "SELECT CAST(5 AS BIGINT) AS sample_id",
    "embedded_mismatches": f"WITH {_D} SELECT sample_id FROM D WHERE sample_id % 7 = 5",
    "sorted_order": f"WITH {_D} SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS seq, sample_id, doc_id, lang, n_chars, source FROM D",
    "metadata_json_round_trip": "SELECT doc_id AS id, doc_id, lang, n_chars, source FROM documents",
    "schema_agreement": "SELECT CASE WHEN count(*) > 0 THEN 'all caches must share the same metadata schema' ELSE 'agreed' END AS message FROM (SELECT column_name FROM (DESCRIBE documents) EXCEPT SELECT column_name FROM (DESCRIBE pages))",
    "write_results_partial_failure": "SELECT 'bad' AS source_name, count(*) = 0 AS written FROM documents UNION ALL SELECT 'good', count(*) > 0 FROM documents",
    "embeddings_round_trip": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS sample_id, vec_id, CAST(label AS BIGINT) AS label, CAST(len(embedding) AS INTEGER) AS n_values FROM embeddings",
}
