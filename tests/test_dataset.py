"""Caches, active tables and streams through the public entry points, on gauge readings made for these tests."""

import io
import json
import struct
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawwell.functions.layout import metadata_columns, metadata_json
from drawwell.operators import active as A
from drawwell.operators import sampling
from drawwell.runtime import DatasetRuntime, decode_payloads
from drawwell.sources import cache as cache_module
from drawwell.sources import inputs
from drawwell.sources.inputs import FrameSource
from drawwell.streaming.progress import Progress, eta_text
from drawwell.types import (
    CacheSourcesDatasetError, CacheSourcesDatasetSuccess, CacheWriteError, CacheWriteSuccess, InvalidInput, ReaderConfig, ShardCompression, WriterConfig, WriterProfilerConfig,
)

BASINS = ["Elbe", "Rhône", "Ebro"]
QUIET = WriterConfig(show_progress=False)


class Readings:
    """n gauge readings; each payload is its number and its level."""

    def __init__(self, name, n, first=0):
        self.name, self.n, self.first = name, n, first

    def __iter__(self):
        for i in range(self.first, self.first + self.n):
            kind = (bytes, bytearray, memoryview)[i % 3]
            yield kind(payload(i)), {"gauge": i, "basin": BASINS[i % 3], "dry": i % 4 == 1, "level": i / 8 if i % 5 else float("nan")}


def payload(i):
    return struct.pack("<qd", i, i / 8)


def gauge(sample):
    assert sample.data == payload(sample.metadata["gauge"])
    return sample.metadata["gauge"]


@pytest.fixture
def runtime(spark):
    return DatasetRuntime(num_workers=3, spark=spark)


def opened(runtime, path, n=7, **config):
    done = runtime.write_cache(Readings("gauges", n), str(path), QUIET)
    return runtime.cached_dataset(done[0].path, ReaderConfig(**{"seed": 11, "shuffle": False} | config))


def test_round_trip(runtime, tmp_path):
    config = WriterConfig(compression=ShardCompression("lz4", 1.5), max_shard_bytes=200, show_progress=False)
    done = runtime.write_cache(Readings("gauges", 40), str(tmp_path), config)
    assert [(type(d), d.source_name, d.reused) for d in done] == [(CacheWriteSuccess, "gauges", False)]
    data = runtime.cached_dataset(done[0].path, ReaderConfig(seed=1, shuffle=False, validate_cache=True))
    assert [gauge(s) for s in data] == list(range(40)) and len(data) == 40
    assert data.get_metadata(include_pos=False).columns == ["cache_id", "sample_id", "basin", "dry", "gauge", "level", "weight"]
    assert runtime.write_cache(Readings("gauges", 0), str(tmp_path), QUIET)[0].reused  # never iterated again
    manifest = json.loads((tmp_path / "gauges" / "manifest.json").read_text())
    assert len(manifest["shards"]) > 10 and sum(s["n"] for s in manifest["shards"]) == 40
    folders = {f.split("/")[0] for f in manifest["files"]}
    assert folders == {f"shard_id={s['shard_id']}" for s in manifest["shards"]}


def test_chunks_of_an_iterable(runtime, tmp_path, monkeypatch):
    """Full chunks go to the staging folder, which the cache doesn't keep."""
    monkeypatch.setattr(inputs, "_CHUNK", 1)
    done = runtime.write_cache(Readings("gauges", 23), str(tmp_path), WriterConfig(prefetch=4, show_progress=False))
    data = runtime.cached_dataset(done[0].path, ReaderConfig(seed=1, shuffle=False))
    assert [gauge(s) for s in data] == list(range(23)) and not (tmp_path / "gauges" / "ingest").exists()


def test_windows_go_round(runtime, tmp_path):
    data = opened(runtime, tmp_path)
    data.set_epoch_len(3)
    assert [[gauge(s) for s in data] for _ in range(4)] == [[0, 1, 2], [3, 4, 5], [6, 0, 1], [2, 3, 4]]
    data.set_epoch_len(16)
    data.update_metadata(data.get_metadata())
    assert [gauge(s) for s in data] == [i % 7 for i in range(16)]


@pytest.mark.parametrize("limit", [0, 4096])
def test_windows_of_both_kinds(runtime, tmp_path, monkeypatch, limit):
    """Small windows are looked up by ids that reach the scan; large ones are joined. Both give the same."""
    monkeypatch.setattr("drawwell.runtime.PRUNED_SAMPLES", limit)
    data = opened(runtime, tmp_path, 9, shuffle=True)
    data.set_epoch_len(20)
    rows = data.window()
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert (" IN (" in plan or "INSET" in plan) == bool(limit)
    want = [r["active_pos"] for r in data.plan(0, 20).orderBy("seq").collect()]
    assert [r["gauge"] for r in rows.orderBy("seq").collect()] == want


def test_sorting_and_putting_together(runtime, tmp_path):
    data = opened(runtime, tmp_path)
    table = data.get_metadata()
    data.update_metadata(table.orderBy(F.desc("gauge")))
    assert [gauge(s) for s in data] == [6, 5, 4, 3, 2, 1, 0]
    data.set_epoch_len(6)
    data.update_metadata(table.orderBy(F.desc("gauge")).where("gauge <> 3").withColumn("note", F.lit("x")))
    assert [gauge(s) for s in data] == [6, 5, 4, 2, 1, 0]
    data.update_metadata(table.where("gauge > 4"), order_by=[F.desc("gauge")])
    assert [gauge(s) for s in data] == [6, 5] * 3
    with pytest.raises(InvalidInput, match="positions repeat"):
        data.update_metadata(table.unionByName(table))
    data.update_metadata(A.concat(A.tail(table, 2), table.where("gauge = 0"), A.tail(table, 2)))
    data.set_epoch_len(5)
    assert [gauge(s) for s in data] == [5, 6, 0, 5, 6]


@pytest.mark.parametrize("weighted", [False, True])
def test_windows_of_draws_join_up(runtime, tmp_path, weighted):
    parts, whole = opened(runtime, tmp_path, shuffle=True), opened(runtime, tmp_path, shuffle=True)
    for d in (parts, whole):
        if weighted:
            d.update_metadata(d.get_metadata().withColumn("weight", F.col("gauge") + 0.5))
    parts.set_epoch_len(4)
    whole.set_epoch_len(12)
    assert [s.sample_id for _ in range(3) for s in parts] == [s.sample_id for s in whole]


def test_weighted_frequencies(spark):
    table = spark.range(4).select(F.col("id").alias("active_pos"), (F.col("id") + 1.0).alias("weight"))
    got = sampling.weighted_draws(table, 3, 0, 8000).groupBy("active_pos").count().toPandas().set_index("active_pos")["count"]
    want = np.array([1, 2, 3, 4]) * 800
    assert (((got.sort_index() - want) ** 2) / want).sum() < 16.3  # chi-square, 3 degrees of freedom, p = 0.001


@pytest.mark.parametrize(
    "edit, message",
    [
        (lambda t: t.where("gauge < 0"), "at least one sample"),
        (lambda t: t.drop("weight"), "missing 'weight'"),
        (lambda t: t.drop("basin"), "missing 'basin'"),
        (lambda t: t.withColumn("basin", F.lit(1)), "must have Arrow type"),
        (lambda t: t.withColumn("sample_id", F.lit(70).cast("long")), "unknown samples metadata row identity cache_id=0 sample_id=70"),
        (lambda t: t.withColumn("cache_id", F.lit(2).cast("long")), "unknown samples metadata row identity cache_id=2 sample_id=0"),
        (lambda t: t.withColumn("sample_id", F.lit(None).cast("long")), "contains null"),
        (lambda t: t.withColumn("cache_id", F.lit(-1).cast("long")), "non-negative"),
        (lambda t: t.withColumn("sample_id", F.lit("x")), "must be an integer"),
        (lambda t: t.withColumn("weight", F.lit(0.0)), "weight 0 must be positive and finite"),
        (lambda t: t.withColumn("weight", F.when(F.col("gauge") == 3, F.lit(float("nan"))).otherwise(1.0)), "weight 3 must be positive and finite"),
        (lambda t: t.withColumn("weight", F.lit("x")), "must be numeric"),
    ],
)
def test_bad_edits_change_nothing(runtime, tmp_path, edit, message):
    data = opened(runtime, tmp_path, 4)
    with pytest.raises(InvalidInput, match=message):
        data.update_metadata(edit(data.get_metadata()))
    assert [gauge(s) for s in data] == [0, 1, 2, 3]


class Broken:
    def __init__(self, name, *items):
        self.name, self.items = name, items

    def __iter__(self):
        for i in self.items:
            if isinstance(i, BaseException):
                raise i
            yield i


@pytest.mark.parametrize(
    "item, message",
    [
        ((3.5, {"a": 1}), "bytes-like"),
        ((b"x", {"a": [1]}), "must be bool, int, float or str"),
        ((b"x", {"byte_len": 1}), "'byte_len' is reserved"),
        ((b"x", {"__row": 1}), "'__row' is reserved"),
        ((b"x", {}), "at least one field"),
        ((b"x",), r"\(data, metadata\) pairs"),
    ],
)
def test_bad_samples(runtime, tmp_path, item, message):
    (done,) = runtime.write_cache(Broken("bad", item), str(tmp_path), QUIET)
    assert isinstance(done, CacheWriteError) and message.replace("\\", "") in done.message
    assert not (tmp_path / "bad").exists() and not (tmp_path / "tmp" / "bad").exists()


def test_dotted_names_and_equal_keys(runtime, spark, tmp_path):
    rows = [(i % 2, f"p{i}".encode()) for i in range(6)] + [(0, b"p0")]
    frame = spark.createDataFrame([(a, bytearray(b)) for a, b in rows], "`a.b` long, payload binary")
    orders = []
    for at, parts in (("one", 1), ("many", 5)):
        (done,) = runtime.write_cache(FrameSource("dots", frame.repartition(parts), ("a.b",)), str(tmp_path / at), QUIET)
        orders.append([(s.metadata["a.b"], s.data) for s in runtime.cached_dataset(done.path, ReaderConfig(seed=1, shuffle=False))])
    assert orders[0] == orders[1] and sorted(orders[0]) == sorted(rows) and [a for a, _ in orders[0]] == sorted(a for a, _ in rows)


def test_several_sources(runtime, tmp_path):
    sources = [Readings("north", 3), Broken("bad", (object(), {"a": 1})), Readings("none", 0), Readings("south", 2, 50)]
    found = runtime.from_cache_sources(sources, str(tmp_path), ReaderConfig(seed=1, shuffle=False), QUIET)
    assert isinstance(found, CacheSourcesDatasetSuccess)
    assert [(r.source_name, type(r)) for r in found.results] == [("north", CacheWriteSuccess), ("bad", CacheWriteError), ("none", CacheWriteError), ("south", CacheWriteSuccess)]
    assert [(s.cache_id, gauge(s)) for s in found.dataset] == [(0, 0), (0, 1), (0, 2), (1, 50), (1, 51)]
    failed = runtime.from_cache_sources(sources[1:3], str(tmp_path), ReaderConfig(seed=1), QUIET)
    assert isinstance(failed, CacheSourcesDatasetError) and "bad: " in failed.message and "'none' has no samples" in failed.message
    with pytest.raises(InvalidInput, match="two sources"):
        runtime.write_cache([Readings("north", 1), Readings("north", 1)], str(tmp_path), QUIET)
    for name in ("tmp", "..", "a/b", "", None):
        with pytest.raises(InvalidInput):
            runtime.write_cache(Readings(name, 1), str(tmp_path), QUIET)


def test_different_schemas(runtime, tmp_path):
    a, b = runtime.write_cache([Readings("a", 2), Broken("b", (b"x", {"other": 1}))], str(tmp_path), QUIET)
    with pytest.raises(InvalidInput, match="same metadata schema"):
        runtime.cached_dataset([a.path, b.path], ReaderConfig(seed=1))


def test_interrupt_ends_the_write_and_leaves_a_report(runtime, tmp_path):
    config = WriterConfig(profiler=WriterProfilerConfig(str(tmp_path / "report.json")), show_progress=False)
    with pytest.raises(KeyboardInterrupt):
        runtime.write_cache([Broken("cut", (b"x", {"a": 1}), KeyboardInterrupt())], str(tmp_path), config)
    assert not (tmp_path / "cut").exists() and not (tmp_path / "tmp" / "cut").exists()
    report = json.loads((tmp_path / "report.json").read_text())
    assert report["sources"][0]["stages"][-1]["stage"] == "interrupt"


def test_profiler(runtime, tmp_path):
    config = WriterConfig(profiler=WriterProfilerConfig(str(tmp_path / "report.json")), show_progress=False)
    runtime.write_cache([Readings("a", 3), Broken("bad", (1, 2))], str(tmp_path), config)
    report = json.loads((tmp_path / "report.json").read_text())
    assert report["format_version"] == 1 and report["elapsed_ns"] > 0
    stages = {s["source_name"]: [x["stage"] for x in s["stages"]] for s in report["sources"]}
    assert stages["a"] == ["prepare", "ingest", "store_rows", "index", "shards", "write", "sums", "checksum", "manifest", "publish"]
    assert stages["bad"] == ["prepare", "failure"]
    assert all(x["calls"] == 1 and x["total_ns"] >= 0 for s in report["sources"] for x in s["stages"])
    runtime.write_cache(Readings("a", 3), str(tmp_path), config)
    assert [x["stage"] for x in json.loads((tmp_path / "report.json").read_text())["sources"][0]["stages"]] == ["reuse"]


def test_progress():
    assert [eta_text(s) for s in (0, 59.9, 60, 3599, 3600, 90_061)] == ["0s", "59s", "1m 00s", "59m 59s", "1h 00m", "25h 01m"]
    out, now = io.StringIO(), iter([0.0, 10.0, 20.0])
    progress = Progress(3, True, out, lambda: next(now))
    progress.done("a", 100, 5_000_000)
    progress.done("b", 0, 0, failed=True)
    assert out.getvalue().splitlines() == ["a: done, 1 of 3 sources, 100 samples (10/s), 5.0 MB (0.5 MB/s), 20s left", "b: failed, 2 of 3 sources, 100 samples (5/s), 5.0 MB (0.2 MB/s), 10s left"]
    Progress(1, False, out).done("c", 1, 1)
    assert out.getvalue().count("\n") == 2


def rewrite(path, edit):
    manifest = json.loads(path.read_text())
    edit(manifest)
    path.write_text(json.dumps(manifest))
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)


@pytest.mark.parametrize(
    "tamper, message",
    [
        (lambda p: (p / "manifest.json").unlink(), "missing manifest"),
        (lambda p: (p / "manifest.json").write_text("{"), "corrupt manifest"),
        (lambda p: rewrite(p / "manifest.json", lambda m: m.update(version=1)), "unsupported format version 1"),
        (lambda p: rewrite(p / "manifest.json", lambda m: m.update(sample_count=9)), "metadata row count does not match manifest"),
        (lambda p: rewrite(p / "manifest.json", lambda m: m["shards"][0].update(n=9)), "index row count does not match manifest"),
        (lambda p: rewrite(p / "manifest.json", lambda m: next(iter(m["files"].values())).update(sha256="0")), "checksum mismatch for shard_id=0/"),
        (lambda p: next(p.glob("samples/shard_id=0/*.parquet")).unlink(), "shard length mismatch for shard_id=0/"),
        (lambda p: next(p.glob("samples/shard_id=0/*.parquet")).open("ab").write(b"x"), "shard length mismatch for shard_id=0/"),
    ],
)
def test_tampered_caches(runtime, tmp_path, tamper, message):
    (done,) = runtime.write_cache(Readings("gauges", 6), str(tmp_path), QUIET)
    tamper(tmp_path / "gauges")
    with pytest.raises(InvalidInput, match=message):
        runtime.cached_dataset(done.path, ReaderConfig(seed=1, validate_cache=True))


def test_altered_metadata(runtime, spark, tmp_path, monkeypatch):
    (done,) = runtime.write_cache(Readings("gauges", 6), str(tmp_path), QUIET)
    real = cache_module.mismatched
    monkeypatch.setattr(cache_module, "mismatched", lambda s, names: real(s.withColumn("gauge", F.when(F.col("sample_id") == 4, F.lit(0).cast("long")).otherwise(F.col("gauge"))), names))
    with pytest.raises(InvalidInput, match="does not match the stored metadata for sample 4"):
        runtime.cached_dataset(done.path, ReaderConfig(seed=1, validate_cache=True))
    assert [gauge(s) for s in runtime.cached_dataset(done.path, ReaderConfig(seed=1, shuffle=False))] == list(range(6))


def test_iterators_stop(runtime, tmp_path, monkeypatch):
    """An iterator that is closed early cancels its jobs by their tag; the next one goes on with the next window."""
    monkeypatch.setattr("drawwell.runtime.LEAST_FETCHED", 2)
    data = opened(runtime, tmp_path, 9, prefetch=2)
    data.set_epoch_len(5)
    cancelled, context = [], runtime.spark.sparkContext
    real = context.cancelJobsWithTag
    monkeypatch.setattr(context, "cancelJobsWithTag", lambda tag: cancelled.append(tag) or real(tag))
    first = iter(data)
    assert gauge(next(first)) == 0
    first.close()
    assert len(cancelled) == 1 and cancelled[0].startswith("drawwell-") and cancelled[0] not in context.getJobTags()
    assert [gauge(s) for s in data] == [5, 6, 7, 8, 0]


def test_torch_view(runtime, tmp_path, monkeypatch):
    data = opened(runtime, tmp_path)
    monkeypatch.setitem(sys.modules, "torch", None)
    with pytest.raises(ImportError):
        data.to_torch_iterable_dataset()
    worker = [None]
    utils = types.ModuleType("torch.utils.data")
    utils.IterableDataset, utils.get_worker_info = object, lambda: worker[0]
    for name, module in (("torch", types.ModuleType("torch")), ("torch.utils", types.ModuleType("torch.utils")), ("torch.utils.data", utils)):
        monkeypatch.setitem(sys.modules, name, module)
    view = data.to_torch_iterable_dataset()
    assert len(view) == 7 and [gauge(s) for s in view] == list(range(7))
    worker[0] = "a worker"
    with pytest.raises(RuntimeError, match="num_workers=0"):
        iter(view)


def test_decoding_payloads(runtime, tmp_path):
    rows = decode_payloads(opened(runtime, tmp_path).window(), lambda b: struct.unpack("<qd", b)[1], "double", "read")
    assert {r["gauge"]: r["read"] for r in rows.collect()} == {i: i / 8 for i in range(7)}


def test_metadata_as_json(spark):
    rows = spark.createDataFrame([(1, None, 0.5, True), (2, "ü\"", float("nan"), None)], "n long, s string, f double, b boolean")
    back = rows.select(metadata_json(["n", "s", "f", "b"]).alias("j")).select("j", metadata_columns(F.col("j"), "n long, s string, f double, b boolean").alias("m")).collect()
    assert back[0]["j"] == '{"b":true,"f":0.5,"n":1,"s":null}'
    assert str([tuple(r["m"]) for r in back]) == str([tuple(r) for r in rows.collect()])


@pytest.mark.parametrize(
    "make, message",
    [
        (lambda: WriterConfig(max_shard_bytes=0), "greater than zero"),
        (lambda: WriterConfig(prefetch=True), "greater than zero"),
        (lambda: ReaderConfig(seed=1, prefetch=0), "greater than zero"),
        (lambda: ReaderConfig(seed=1, colour=2), "no option 'colour'"),
        (lambda: WriterConfig(colour=2), "no option 'colour'"),
        (lambda: ShardCompression("zip"), "unknown compression"),
        (lambda: ShardCompression("none", 2.0), "compression ratio"),
        (lambda: ShardCompression("lz4", float("inf")), "compression ratio"),
        (lambda: WriterProfilerConfig(""), "needs a path"),
        (lambda: DatasetRuntime(0), "num_workers"),
    ],
)
def test_configurations(make, message):
    with pytest.raises(InvalidInput, match=message):
        make()
