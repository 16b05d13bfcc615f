"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from drawwell.llm.decontaminate import op7_decontaminate
from drawwell.llm.language_id import op6_language_id
from drawwell.llm.lm_score import op8_lm_score
from drawwell.llm.mixing import op3_mix_sources
from drawwell.llm import quality_rules as Q
from drawwell.llm.quality_rules import op4_quality_rules
from drawwell.llm.secret_scan import op1_secret_scan
from drawwell.llm.simhash import op2_simhash
from drawwell.llm.suffix_dedup import op9_suffix_dedup
from drawwell.llm.token_count import op10_token_counts
from drawwell.llm.toxicity import op5_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_simhash,
        op3_mix_sources,
        op4_quality_rules,
        op5_toxicity,
        op6_language_id,
        op7_decontaminate,
        op8_lm_score,
        op9_suffix_dedup,
        op10_token_counts,
    )
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


def _divergence(p: str, q: str) -> str:
    """What one bin adds to twice the Jensen-Shannon divergence of p and q."""
    return " + ".join(f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({p} + {q})) ELSE 0 END" for x in (p, q))


def _count(pattern: str) -> str:
    return "len(regexp_extract_all(t, '" + pattern.replace("'", "''") + "'))"


_COMMON = ", ".join(f"'{w}'" for w in sorted(set(Q.COMMON_WORDS)))
_CLASSES = ", ".join(map(_count, Q.CHAR_CLASSES))

_QUALITY = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM docs),
grams AS (SELECT r, p, x, lead(x, 1) OVER a AS y, lead(x, 2) OVER a AS z FROM words WINDOW a AS (PARTITION BY r ORDER BY p)),
twice AS (SELECT r, p, count(*) OVER (PARTITION BY r, x, y, z) AS n FROM grams WHERE z IS NOT NULL),
repeats AS (SELECT r, count(DISTINCT q) AS n_repeat FROM (SELECT r, unnest(range(p, p + 3)) AS q FROM twice WHERE n > 1) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
sizes AS (SELECT r, len(w) AS n_words, length(t) AS n_chars, length(array_to_string(w, '')) AS inside, [{_CLASSES}] AS c FROM docs),
bins AS (SELECT r, unnest(range(1, {Q.N_CLASSES + 1})) AS i, unnest(list_concat([n_chars - inside], list_concat(c, [inside - CAST(list_sum(c) AS BIGINT)]))) AS n FROM sizes),
found AS (SELECT r, unnest(regexp_extract_all(lower(t), '\p{{L}}+')) AS k FROM docs),
common AS (SELECT r, k, count(*) AS n FROM found WHERE k IN ({_COMMON}) GROUP BY r, k),
refs AS (SELECT lang AS ref FROM docs JOIN sizes USING (r) WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= {Q.MIN_REFERENCE_WORDS}),
owners AS (SELECT r, coalesce('=' || ref, 'pool') AS ref FROM docs LEFT JOIN refs ON lang = ref),
members AS (SELECT r, ref FROM owners WHERE ref <> 'pool' UNION ALL SELECT r, 'pool' FROM docs),
ref_sizes AS (SELECT ref, CAST(sum(n_words) AS DOUBLE) AS ref_n, CAST(sum(n_chars) AS DOUBLE) AS ref_chars FROM members JOIN sizes USING (r) GROUP BY ref),
ref_bins AS (SELECT ref, i, CAST(sum(n) AS DOUBLE) AS m FROM members JOIN bins USING (r) GROUP BY ref, i),
ref_words AS (SELECT ref, k, CAST(sum(n) AS DOUBLE) AS m FROM members JOIN common USING (r) GROUP BY ref, k),
shares AS (
    SELECT r, n / nullif(CAST(n_chars AS DOUBLE), 0) AS a, m / nullif(ref_chars, 0) AS b
    FROM bins JOIN sizes USING (r) JOIN owners USING (r) JOIN ref_sizes USING (ref) JOIN ref_bins USING (ref, i)),
class_parts AS (SELECT r, sum({_divergence('a', 'b')}) AS d FROM shares GROUP BY r),
known AS (SELECT ref, ref_n, coalesce(sum(m), 0) / nullif(ref_n, 0) AS known FROM ref_sizes LEFT JOIN ref_words USING (ref) GROUP BY ref, ref_n),
word_shares AS (
    SELECT r, CAST(n AS DOUBLE) / n_words AS a, m / ref_n AS b
    FROM common JOIN sizes USING (r) JOIN owners USING (r) JOIN known USING (ref) JOIN ref_words USING (ref, k) WHERE n_words >= {Q.MIN_WORDS}),
word_sums AS (SELECT r, sum({_divergence('a', 'b')}) AS d, sum(a) AS a, sum(b) AS b FROM word_shares GROUP BY r),
others AS (
    SELECT r, coalesce(d, 0) AS d, known - coalesce(b, 0) AS missing, greatest(1 - coalesce(a, 0), 0) AS a, greatest(1 - known, 0) AS b
    FROM sizes JOIN owners USING (r) JOIN known USING (ref) LEFT JOIN word_sums USING (r)),
distances AS (
    SELECT r, CASE WHEN n_chars >= {Q.MIN_CHARS} THEN sqrt(greatest(coalesce(p.d, 0) / 2, 0)) ELSE 0 END AS class_distance,
        CASE WHEN n_words >= {Q.MIN_WORDS} THEN sqrt(greatest((o.d + missing + {_divergence('a', 'b')}) / 2, 0)) ELSE 0 END AS word_distance
    FROM sizes JOIN class_parts AS p USING (r) JOIN others AS o USING (r)),
measured AS (
    SELECT r, doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(inside AS BIGINT) AS word_chars, CAST({_count('[#*$%&|<>]')} AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
    FROM docs JOIN sizes USING (r) JOIN lines USING (r) LEFT JOIN repeats USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND class_distance <= {Q.MAX_CLASS_DISTANCE} AND word_distance <= {Q.MAX_WORD_DISTANCE} AS kept,
    round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM measured JOIN distances USING (r)"""


def _doubled(width: int) -> str:
    """Classes of equal strings of `width` bytes (256 at most) at every byte, from classes at doubling lengths."""
    steps, at, k = [], "bytes", 1
    while k < width:
        gap = min(k, width - k)
        steps.append(f"pairs{k} AS (SELECT g, r, p, c, lead(c, {gap}) OVER (PARTITION BY r ORDER BY p) AS d FROM {at})")
        steps.append(f"same{k} AS (SELECT g, r, p, min(g) OVER (PARTITION BY c, d) AS c FROM pairs{k})")
        at, k = f"same{k}", k + gap
    return ",\n".join(steps) + f",\nstrings AS (SELECT * FROM {at})"


#: op4: windows compared word by word, histograms and distances in long tables. op7: every run of up to ten document words against every window of the items, by equality of the words. op9: classes
#: of equal 200-byte strings, without hashes.
ORACLES: dict[str, str] = {
    "op4_quality_rules": _QUALITY,
    "op7_decontaminate": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, row_number() OVER () AS i, {_WORDS} AS w FROM benchmark),
item_runs AS (
    SELECT item, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda a: array_to_string(w[a:a + least(10, len(w)) - 1], ' '))) AS k
    FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, k FROM item_runs),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM docs),
runs AS (SELECT r, p, list(word) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM words),
sized AS (SELECT r, p, n, array_to_string(l[1:n], ' ') AS k FROM runs JOIN (SELECT DISTINCT n FROM windows) AS s ON len(l) >= n),
hits AS (SELECT r, p, n, item FROM sized JOIN windows USING (n, k)),
hit_words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
held AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN held USING (r)""",
    "op9_suffix_dedup": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) AS n, regexp_extract_all(hex(coalesce(text, '')), '..') AS b FROM documents),
each AS (SELECT r, n, unnest(range(1, n + 1)) AS p, unnest(b) AS byte FROM docs),
bytes AS (SELECT row_number() OVER () AS g, r, p, CAST('0x' || byte AS BIGINT) AS c FROM each),
{_doubled(200)},
whole AS (SELECT r, p, c FROM strings JOIN docs USING (r) WHERE p + 199 <= n),
starts AS (SELECT r, p, count(*) OVER (PARTITION BY c) > 1 AS twice FROM whole),
marked AS (
    SELECT r, p, byte, coalesce(max(CAST(twice AS INT)) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 0) AS gone
    FROM each LEFT JOIN starts USING (r, p)),
edges AS (SELECT *, gone = 1 AND lag(gone, 1, 0) OVER (PARTITION BY r ORDER BY p) = 0 AS opens FROM marked),
sums AS (
    SELECT r, sum(gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (gone = 0) AS kept
    FROM edges GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs LEFT JOIN sums USING (r)""",
}
