"""Caches: a folder with a manifest and Parquet samples, written beside its place and moved there whole."""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawwell.functions.layout import assign_shards, record_length
from drawwell.operators.active import dense_index
from drawwell.sources.inputs import FrameSource, check_name, check_schema, source_frame
from drawwell.sources.shared import Store, snapshot
from drawwell.streaming.progress import Progress
from drawwell.types import CacheWriteError, CacheWriteSuccess, InvalidInput, WriterConfig

VERSION = 3


def _path(base: str, *parts: str) -> str:
    return "/".join([base.rstrip("/"), *parts])


def read_manifest(spark: SparkSession, path: str) -> dict:
    store = Store(spark, path)
    if not store.exists(_path(path, "manifest.json")):
        raise InvalidInput(f"missing manifest: {path}")
    try:
        manifest = json.loads(store.read(_path(path, "manifest.json")))
    except (ValueError, Py4JJavaError) as e:  # the store may see by its own checksum that the file was changed
        raise InvalidInput(f"corrupt manifest: {path}") from e
    if manifest.get("version") != VERSION:
        raise InvalidInput(f"unsupported format version {manifest.get('version')}")
    return manifest


def file_checksums(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of each sample file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(_path(path, "samples"))
    rows = files.select(F.regexp_extract("path", "^.*/samples/(.*)$", 1).alias("file"), F.sha2("content", 256).alias("sha256")).collect()
    return {r["file"]: r["sha256"] for r in rows}


def record_hash(names: list[str]):
    return F.sha2(F.concat(F.to_json(F.struct(*(F.col(f"`{c}`") for c in names))).cast("binary"), F.col("payload")), 256)


class Profile:
    """Calls, time and bytes by source and stage."""

    def __init__(self):
        self.began, self.lock, self.stages = time.perf_counter_ns(), Lock(), {}

    def add(self, source: str, stage: str, total_ns: int, n_bytes: int = 0) -> None:
        with self.lock:
            own = self.stages.setdefault(source, {}).setdefault(stage, {"calls": 0, "total_ns": 0, "bytes": 0})
            own["calls"] += 1
            own["total_ns"] += total_ns
            own["bytes"] += n_bytes

    def report(self) -> str:
        sources = [{"source_name": s, "stages": [{"stage": k, **v} for k, v in stages.items()]} for s, stages in self.stages.items()]
        return json.dumps({"format_version": 1, "elapsed_ns": time.perf_counter_ns() - self.began, "sources": sources}, indent=2)


def write_one(spark: SparkSession, source, base: str, config: WriterConfig, profile: Profile, progress: Progress) -> CacheWriteSuccess | CacheWriteError:
    """Write a source to base/name. An existing cache with a readable manifest is reused as it is.

    Payloads are written once with an id for each row; order and shards are made of narrow rows and joined to them. Each
    shard has a folder of its own, so files are no larger than shards.
    """
    name = check_name(getattr(source, "name", None))
    path, staged = _path(base, name), _path(base, "tmp", name)
    store = Store(spark, path)
    began = time.perf_counter_ns()

    def stage(what: str, n_bytes: int = 0) -> None:
        nonlocal began
        now = time.perf_counter_ns()
        profile.add(name, what, now - began, n_bytes)
        began = now

    try:
        if store.exists(path):
            known, _ = load_cache(spark, path, config.validate_cache)
            stage("reuse")
            progress.done(name, known["sample_count"], 0)
            return CacheWriteSuccess(name, path, True)
        store.delete(staged)
        stage("prepare")
        frame, keys = source_frame(spark, source, _path(staged, "ingest"), config.prefetch)
        if frame is None:
            raise InvalidInput(f"source '{name}' has no samples")
        names = check_schema(frame.drop("__seq").schema)
        stage("ingest")
        lasting = snapshot(frame.withColumn("__row", F.monotonically_increasing_id()), "rows")
        stage("store_rows")
        everything = F.xxhash64(*(F.col(f"`{c}`") for c in [*names, "payload"])).alias("__tie")
        narrow = lasting.select(*(F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(keys)), everything, "__row", record_length(names).alias("byte_len"))
        placed = dense_index(narrow, [*(f"__key{i}" for i in range(len(keys))), "__tie"], "sample_id").select("sample_id", "byte_len", "__row")
        stage("index")
        # with compression a record counts for what its payload is expected to take
        packed = F.ceil(F.col("byte_len") / config.compression.ratio).cast("long").alias("byte_len")
        shards = assign_shards(placed.select("sample_id", packed), config.max_shard_bytes).select(F.col("sample_id").alias("__id"), "shard_id")
        placed = snapshot(placed.join(shards, F.col("sample_id") == F.col("__id")).select(F.col("__row").alias("__own"), "sample_id", "byte_len", "shard_id"), "shards")
        stage("shards")
        rows = lasting.join(placed, F.col("__row") == F.col("__own"))
        rows = rows.select("sample_id", "shard_id", "byte_len", *(f"`{c}`" for c in names), "payload", F.sha2("payload", 256).alias("payload_sha256"), record_hash(names).alias("record_sha256"))
        ordered = rows.repartitionByRange("shard_id", "sample_id").sortWithinPartitions("shard_id", "sample_id")
        ordered.write.option("compression", config.compression.codec).partitionBy("shard_id").parquet(_path(staged, "samples"))
        store.delete(_path(staged, "ingest"))
        stage("write")
        written = spark.read.schema(rows.schema).parquet(_path(staged, "samples"))
        sums = written.groupBy("shard_id").agg(F.count("*").alias("n"), F.sum("byte_len").alias("byte_len"), F.sum(F.octet_length("payload")).alias("payload_bytes")).orderBy("shard_id").collect()
        count = sum(r["n"] for r in sums)
        if not count:
            raise InvalidInput(f"source '{name}' has no samples")
        stage("sums", sum(r["byte_len"] for r in sums))
        checksums = file_checksums(spark, staged)
        stage("checksum", sum(r["byte_len"] for r in sums))
        manifest = {
            "version": VERSION, "source_name": name, "sample_count": count, "codec": config.compression.codec,
            "metadata_schema": {c: rows.schema[c].dataType.simpleString() for c in names},
            "shards": [r.asDict() for r in sums],
            "files": {f: {"length": n, "sha256": checksums[f]} for f, n in sorted(store.lengths(_path(staged, "samples")).items())},
        }
        store.write(_path(staged, "manifest.json"), json.dumps(manifest, indent=2))
        stage("manifest")
        if store.exists(path) or not store.rename(staged, path):
            raise InvalidInput(f"cannot publish {path}")
        stage("publish")
        progress.done(name, count, sum(r["payload_bytes"] for r in sums))
        return CacheWriteSuccess(name, path, False)
    except Exception as e:
        store.delete(staged)
        stage("failure")
        progress.done(name, 0, 0, failed=True)
        return CacheWriteError(name, str(e))
    except BaseException:  # an interrupt ends the whole call, and leaves no half cache
        store.delete(staged)
        stage("interrupt")
        raise


def write_cache(spark: SparkSession, sources, base: str, config: WriterConfig | None = None, workers: int = 1):
    """Write one source, or a list of them, `workers` at a time; the results are in the same form and order."""
    config, many, profile = config or WriterConfig(), isinstance(sources, list | tuple) and not isinstance(sources, FrameSource), Profile()
    listed = list(sources) if many else [sources]
    names = [check_name(getattr(s, "name", None)) for s in listed]
    if twice := [n for i, n in enumerate(names) if n in names[:i]]:
        raise InvalidInput(f"two sources write to {_path(base, twice[0])}")
    progress = Progress(len(listed), config.show_progress)
    try:
        if workers > 1 and len(listed) > 1:
            with ThreadPoolExecutor(min(workers, len(listed))) as pool:
                running = [pool.submit(write_one, spark, s, base, config, profile, progress) for s in listed]
                try:
                    results = [r.result() for r in running]
                except BaseException:
                    pool.shutdown(wait=True, cancel_futures=True)
                    raise
        else:
            results = [write_one(spark, s, base, config, profile, progress) for s in listed]
    finally:
        if config.profiler:
            store = Store(spark, config.profiler.path)
            store.delete(config.profiler.path)
            store.write(config.profiler.path, profile.report())
    return results if many else results[0]


def load_cache(spark: SparkSession, path: str, validate: bool = False) -> tuple[dict, DataFrame]:
    """The manifest and the samples of a cache. File lengths and the count are always checked, contents on request."""
    manifest = read_manifest(spark, path)
    lengths = Store(spark, path).lengths(_path(path, "samples"))
    for file, known in manifest["files"].items():
        if lengths.get(file) != known["length"]:
            raise InvalidInput(f"shard length mismatch for {file}")
    names = sorted(manifest["metadata_schema"])
    columns = ["sample_id long", "byte_len long", *(f"`{c}` {manifest['metadata_schema'][c]}" for c in names)]
    schema = ", ".join([*columns, "payload binary", "payload_sha256 string", "record_sha256 string", "shard_id long"])
    samples = spark.read.schema(schema).parquet(_path(path, "samples"))
    found = {r["shard_id"]: r["n"] for r in samples.groupBy("shard_id").agg(F.count("*").alias("n")).collect()}  # a row a shard
    if sum(found.values()) != manifest["sample_count"]:
        raise InvalidInput("metadata row count does not match manifest")
    if found != {s["shard_id"]: s["n"] for s in manifest["shards"]}:
        raise InvalidInput("index row count does not match manifest")
    if validate:
        for file, found in file_checksums(spark, path).items():
            if manifest["files"].get(file, {}).get("sha256") != found:
                raise InvalidInput(f"checksum mismatch for {file}")
        if bad := mismatched(samples, names).orderBy("sample_id").select("sample_id").limit(1).collect():
            raise InvalidInput(f"embedded metadata does not match the stored metadata for sample {bad[0][0]}")
    return manifest, samples


def mismatched(samples: DataFrame, names: list[str]) -> DataFrame:
    """Samples whose metadata or payload no longer has the hash that was stored with them."""
    return samples.where(~record_hash(names).eqNullSafe(F.col("record_sha256")))
