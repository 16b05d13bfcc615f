"""The opN_ queries and the pipeline over small whole tables, against brute force written apart from the operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from test_llm import SPACE, docs, empty, naive_base, rows  # noqa: F401

from drawwell.llm import language_id, lm_score, mixing, toxicity
from drawwell.llm.queries import QUERIES


def remainder(doc_id, folds):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(SPACE, text or "")


@pytest.fixture(scope="module")
def sf(spark, docs, rows, tmp_path_factory):  # noqa: F811
    base = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{base}/documents.parquet")
    docs.where("1 = 0").write.parquet(f"{base}/none/documents.parquet")
    labels = [(i, i % 2, i % 3 % 2) for i in range(len(rows))] + [(2, 1, 1), (5, None, None), (None, 1, 1), (10_000, 1, 1)]
    items = [(1, rows[14][1]), (2, "one"), (3, None), (None, rows[4][1][:300])]
    for to in (base, base / "none"):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return str(base)


def run(spark, sf, name, *columns):
    return sorted(str(tuple(r)) for r in QUERIES[name](spark, sf).select(*columns).collect())


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_documents(spark, sf, name):
    import corpus_pipeline

    assert {**QUERIES, "pipeline": corpus_pipeline.run}[name](spark, f"{sf}/none").collect() == []


def test_op1(spark, sf, rows):  # noqa: F811
    want = []
    for r in rows:
        base = naive_base(r[1])
        n = Counter(k for k, *_ in base)
        want.append((r[0], n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))))
    assert run(spark, sf, "op1_secret_scan", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(map(str, want))
    for r in QUERIES["op1_secret_scan"](spark, sf).collect():
        listed = [x for x in r["spans"].split(",") if x]
        assert r["n_assign"] + r["n_access"] + r["n_hex"] + r["n_confirmed"] == len(listed) and listed == sorted(listed, key=lambda x: int(x.split(":")[1]))


def test_op2(spark, sf, rows):  # noqa: F811
    fps = []
    for r in rows:
        own = words("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))
        grams = [" ".join(own[i : i + 4]) for i in range(max(1, len(own) - 3))] if own else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = defaultdict(list)
    for g, r in zip(group, rows, strict=True):
        least[g] += [] if r[0] is None else [r[0]]
    want = [(r[0], f"{f:016x}", min(least[g], default=None)) for r, f, g in zip(rows, fps, group, strict=True)]
    assert run(spark, sf, "op2_simhash", "doc_id", "fingerprint", "component_id") == sorted(map(str, want))


def shared_out(sizes):
    """Targets by source: weights 1, 2, 3, repeating; what passes 3 times a source's size is shared again by weight."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    fixed, left, open_ = {}, float(sum(sizes.values())), list(order)
    while True:
        unit = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if unit * weight[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: unit * weight[s] for s in open_}
        for s in over:
            fixed[s] = 3.0 * sizes[s]
            left -= fixed[s]
            open_.remove(s)


def test_op3(spark, sf, rows):  # noqa: F811
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    targets = shared_out(sizes)
    want = sorted((len(words(r[1])), sizes[r[3]], round(targets[r[3]], 6)) for r in rows)
    got = QUERIES["op3_mix_sources"](spark, sf).collect()
    assert sorted((r["size"], r["source_size"], round(r["target"], 6)) for r in got) == want
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = defaultdict(int)
    for r in got:
        by[r["source_size"], round(r["target"], 6)] += r["taken"]
    for (size, target), taken in by.items():
        if size:
            assert abs(taken - target) <= mixing.BLOCK_WORDS
    assert run(spark, sf, "op3_mix_sources", "doc_id", "size", "taken") == run(spark, sf, "op3_mix_sources", "doc_id", "size", "taken")


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 1000, "c": 1}, {"a": 5, None: 7}, {"z": 0, "a": 9, "m": 2, "q": 100_000, None: 3}, {"a": 0}])
def test_targets(spark, sizes):
    placed = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(placed).collect()}
    assert got == pytest.approx(shared_out(sizes))


def test_running_sums(spark):
    rng = random.Random(1)
    data = [(g, at, rng.randint(0, 9)) for g in (1, 2, 7) for at in rng.sample(range(60), 25)]
    got = mixing.running_before(spark.createDataFrame(data, "code long, shard long, n long"), "code", "shard", "n", "before", 8).collect()
    assert sorted(map(tuple, got)) == sorted((g, at, n, sum(m for h, b, m in data if h == g and b < at)) for g, at, n in data)


def slow_ftrl(sets, labels, epochs):
    """FTRL-proximal by its definition, one coordinate at a time."""
    z, n, alpha, beta, l1 = defaultdict(float), defaultdict(float), toxicity.ALPHA, toxicity.BETA, toxicity.L1
    weight = lambda i, cut: 0.0 if abs(z[i]) <= cut else -(z[i] - math.copysign(cut, z[i])) / ((beta + math.sqrt(n[i])) / alpha)
    for _ in range(epochs):
        for x, y in zip(sets, labels, strict=True):
            w = {i: weight(i, l1) for i in x} | {"bias": weight("bias", 0.0)}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in w:
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - s * w[i]
                n[i] += g * g
    return {i: weight(i, l1) for i in z if i != "bias" and abs(z[i]) > l1}, weight("bias", 0.0)


def test_ftrl():
    rng = random.Random(4)
    sets = [sorted({*rng.sample(range(400), 25), *([7, 11] if i % 3 == 0 else [])}) for i in range(300)]
    labels = [int(i % 3 == 0) for i in range(300)]
    at, w, bias = toxicity.fit_ftrl([np.array(x, np.int32) for x in sets], labels, 3)
    want, want_bias = slow_ftrl(sets, labels, 3)
    assert set(at.tolist()) == set(want) and len(want) < 200 and bias == pytest.approx(want_bias, rel=1e-3)
    assert dict(zip(at.tolist(), w.tolist(), strict=True)) == pytest.approx(want, rel=1e-2, abs=1e-3)


def test_op5(spark, sf, rows):  # noqa: F811
    got = QUERIES["op5_toxicity"](spark, sf).collect()
    assert sorted(str((r["doc_id"], r["held_out"])) for r in got) == sorted(str((r[0], remainder(r[0], 5) == 0)) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert run(spark, sf, "op5_toxicity", "doc_id", "score") == run(spark, sf, "op5_toxicity", "doc_id", "score")


def test_toxicity_sample(spark):
    """The sample keeps to both bounds, takes a repeated row once and the largest label of an id."""
    data = [(i, "x" * (10 * (i % 7))) for i in range(60)] * 3 + [(None, "y"), (5, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")  # noqa: F811
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (4, 1), (6, None), (None, 1)], "doc_id long, toxic int")
    every = toxicity.sampled(docs, labels).collect()
    assert len(every) == 61 and {r["id"]: r["toxic"] for r in every} == {i: int(i % 2 or i == 4) for i in range(60)}
    assert len(toxicity.sampled(docs, labels, 20).collect()) == 20
    few = toxicity.sampled(docs, labels, 60, 200).join(docs.distinct(), (toxicity.F.col("id") == docs["doc_id"]) & (toxicity.F.xxhash64("text") == toxicity.F.col("tie"))).collect()
    assert 0 < sum(len(r["text"] or "") for r in few) <= 200


def slow_language(texts, text):
    """(languages with proportions, the probability of the first) by counting 4-grams in dictionaries and looping EM."""

    def bins(t):
        letters = "".join(c if ord(c) >= 0x80 or "a" <= c <= "z" else " " for c in t.lower()).encode()
        b = b" " + b" ".join(letters.split()) + b" "
        grams = [int.from_bytes(b[i : i + 4], "little") for i in range(len(b) - 3)]
        return Counter((g * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for g in grams)

    counts = defaultdict(Counter)
    for t, lang in texts:
        if t is not None and lang is not None:
            counts[lang] += bins(t)
    langs = sorted(counts)
    prob = lambda lang, b: (counts[lang][b] + 0.5) / (sum(counts[lang].values()) + 0.5 * 65536)
    own = bins(text)
    total = sum(own.values())

    def em(some):
        share = [1 / len(some)] * len(some)
        for _ in range(12):
            new = [0.0] * len(some)
            for b, n in own.items():
                each = [s * prob(lang, b) for s, lang in zip(share, some, strict=True)]
                for i, e in enumerate(each):
                    new[i] += n * e / sum(each) / total
            share = new
        return share, sum(n * math.log(sum(s * prob(lang, b) for s, lang in zip(share, some, strict=True))) for b, n in own.items())

    alone = {lang: sum(n * math.log(prob(lang, b)) for b, n in own.items()) for lang in langs}
    first = max(langs, key=lambda lang: alone[lang])
    share = dict(zip(langs, em(langs)[0], strict=True))
    order = [first, *(x for x in sorted(langs, key=lambda x: -share[x]) if x != first and share[x] > 1e-3)]
    best, chosen = alone[first], {first: 1.0}
    for k in range(2, len(order) + 1):
        share, likelihood = em(order[:k])
        if likelihood - 4.0 * math.log(total + 1) <= best:
            break
        best, chosen = likelihood - 4.0 * math.log(total + 1), dict(zip(order[:k], share, strict=True))
    top = max(chosen, key=lambda x: chosen[x])
    return chosen, chosen[top] if len(chosen) > 1 else 1 / sum(math.exp(a - alone[first]) for a in alone.values())


def test_languages_slow(spark):
    en, fr, de = "the house of the man is on the hill", "la maison de l homme est sur la colline", "das haus des mannes steht auf dem hügel"
    texts = [(en, "en"), (fr, "fr"), (de, "de"), (None, "en"), ("x", None)]
    model = language_id.LanguageModel.fit(spark.createDataFrame(texts, "text string, lang string"))
    for text in ("the man", "colline maison", (en + " ") * 9 + (fr + " ") * 6, f"{en} {fr} {de} " * 8, "Ж", "hügel 12 Haus!"):
        (got, sure), (want, want_sure) = model.judge(text), slow_language(texts, text)
        assert dict(got) == pytest.approx(want) and sure == pytest.approx(want_sure), text
    assert model.judge("x") == ([("de", 1.0)], 1 / 3) and model.judge("12") == ([], 0.0)


def test_op6(spark, sf, rows):  # noqa: F811
    learned = [(r[1], r[2]) for r in rows if remainder(r[0], 4) != 2]
    got = QUERIES["op6_language_id"](spark, sf).collect()
    assert sorted(str((r["doc_id"], r["held_out"])) for r in got) == sorted(str((r[0], remainder(r[0], 4) == 2)) for r in rows)
    by_id = {r["doc_id"]: r for r in got}
    for r in rows:
        if r[0] is not None and r[0] < 40 and len(r[1] or "") < 3000:
            mine = by_id[r[0]]
            if not re.search(r"[^\W\d_]", r[1] or ""):
                assert (mine["lang_pred"], mine["score"]) == ("und", 0)
            elif len(r[1]) > 1:
                want, sure = slow_language(learned, r[1])
                assert mine["lang_pred"] == max(want, key=lambda x: want[x]) and mine["score"] == pytest.approx(sure, abs=1e-3)


def test_op8(spark, sf, rows):  # noqa: F811
    grams, after = Counter(), defaultdict(set)
    texts = [lm_score.tokens(r[1]) for r in rows if remainder(r[0], 5) != 1]
    for t in texts:
        for k in (1, 2, 3):
            for i in range(len(t) - k + 1):
                grams[tuple(t[i : i + k])] += 1
                after[tuple(t[i : i + k - 1])].add(t[i + k - 1])
    n, v = sum(map(len, texts)), len(after[()])

    def p(context, w):
        if not context:
            return (grams[w,] + 0.5) / (n + 0.5 * (v + 1))
        if not grams[context]:
            return p(context[1:], w)
        return (max(grams[(*context, w)] - 0.75, 0) + 0.75 * len(after[context]) * p(context[1:], w)) / grams[context]

    want = []
    for r in rows:
        t = lm_score.tokens(r[1])
        base, score = sum(math.log10(p((), w)) for w in t), sum(math.log10(p(tuple(t[max(i - 2, 0) : i]), w)) for i, w in enumerate(t))
        want.append((str(r[0]), remainder(r[0], 5) == 1, len(t), sum(grams[w,] > 0 for w in t), n, base, score))
    got = sorted((str(r[0]), *r[1:]) for r in QUERIES["op8_lm_score"](spark, sf).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_op10(spark, sf, rows):  # noqa: F811
    tokenizers, sentencepiece = pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    want = [(r[0], len((r[1] or "").encode()), n := len(sp.encode(r[1] or "")), n > 4096) for r in rows]
    assert run(spark, sf, "op10_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(map(str, want))


def test_pipeline_rows(spark, tmp_path):
    """run() against what each stage must do to planted rows, with nulls, repeated rows and clashing names."""
    import corpus_pipeline

    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    item, copied = prose(30), prose(50)
    data = [(i, prose(60) + (" vile" if i % 4 == 0 else ""), ["s1", "s2", None][i % 3]) for i in range(160)]
    data += [(200, copied, "s1"), (201, copied, "s2"), (201, copied, "s2"), (202, copied + " ", None), (203, None, "s1"), (204, "", "s2"), (205, prose(9) + " " + item, "s1"), (206, prose(40) + " token=abcdefghijk end", "s2"), (207, prose(2), None)]
    frame = spark.createDataFrame([(i, t, "en", s, None, 1, 2, 3) for i, t, s in data], "doc_id long, text string, lang string, source string, n_chars long, __id int, __tie int, __score int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {i: (t, s) for i, t, s in data if not (i < 160 and i % 4 == 0) and i not in (201, 202, 204, 205)}
    kept[206] = (kept[206][0].replace("token=abcdefghijk", "[secret]"), kept[206][1])
    sizes = Counter()
    for t, s in kept.values():
        sizes[s] += len(words(t))
    targets = shared_out(sizes)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = sorted((i, len(words(t)), sizes[s], round(targets[s], 6)) for i, (t, s) in kept.items())
    assert sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == want
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
