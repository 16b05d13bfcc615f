"""The public entry points: a runtime that writes caches, and datasets that draw samples from them."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawwell.operators import active as A
from drawwell.operators import sampling
from drawwell.sources.cache import load_cache, write_cache
from drawwell.streaming.cursor import Cursor
from drawwell.types import (
    CachedSample, CacheSourcesDatasetError, CacheSourcesDatasetSuccess, CacheWriteError, CacheWriteSuccess, InvalidInput, ReaderConfig, WriterConfig,
)

#: Windows of so many samples at most are looked up by their ids, which are pushed down to the files.
PRUNED_SAMPLES = 4096
#: Samples that an iterator fetches at once at least.
LEAST_FETCHED = 1024


def decode_payloads(samples: DataFrame, decode: Callable[[bytes], object], kind: str, name: str = "decoded") -> DataFrame:
    """samples with a column of what decode makes of each payload, as a Spark type; a null payload stays null. Payloads
    go to Python in Arrow batches."""
    schema = T.StructType([*samples.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
    arrow = samples.sparkSession.createDataFrame([], schema).select(name).toArrow().schema.field(0).type

    def decoded(batches):
        for batch in batches:
            values = [None if x is None else decode(x) for x in batch.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow)], [*batch.schema.names, name])

    return samples.mapInArrow(decoded, schema)


class CachedDataset:
    """Caches in a given order, an active table, and the cursors of their streams."""

    def __init__(self, spark: SparkSession, paths: list[str], config: ReaderConfig):
        if not paths:
            raise InvalidInput("CachedDataset requires at least one cache path")
        loaded = [load_cache(spark, p, config.validate_cache) for p in paths]
        schemas = [m["metadata_schema"] for m, _ in loaded]
        if any(s != schemas[0] for s in schemas):
            raise InvalidInput("all caches must share the same metadata schema")
        self.spark, self.config, self.names = spark, config, sorted(schemas[0])
        self.counts = [m["sample_count"] for m, _ in loaded]
        self.samples = None
        for i, (_, s) in enumerate(loaded):
            s = s.withColumn("cache_id", F.lit(i).cast("long"))
            self.samples = s if self.samples is None else self.samples.unionByName(s)
        self._full = A.active_table([s for _, s in loaded], self.names)
        self._stored = self._full.select(*(f"`{c}`" for c in self.names)).schema
        self._active, self._weighted = self._full, False
        self._population = sum(self.counts)
        self._cursor = Cursor(self._population)

    def __len__(self) -> int:
        return self._cursor.epoch_len

    def set_epoch_len(self, n: int) -> None:
        if not isinstance(n, int) or n <= 0:
            raise InvalidInput("epoch length must be greater than zero")
        self._cursor.epoch_len = n

    def get_metadata(self, include_pos: bool = True) -> DataFrame:
        """The active table, with its order in active_pos."""
        return self._active if include_pos else self._active.orderBy(A.POS).drop(A.POS)

    def update_metadata(self, table: DataFrame, order_by: list | None = None) -> None:
        """Replace the active table as a whole, or raise and change nothing. Extra columns stay. The order is order_by's,
        else that of a sort that came last, else active_pos, or identities if that is gone. Tables put together repeat
        positions, so they need order_by, or operators.active.concat."""
        A.check_schema(table, self._stored)
        if not order_by and A.POS in table.columns and not A.sorted_at_top(table) and A.positions_repeat(table):
            raise InvalidInput("positions repeat: give order_by, or put tables together with concat")
        fresh = A.ordered(table, order_by)
        counts = self.spark.createDataFrame(list(enumerate(self.counts)), "cache long, n long")
        A.validate(fresh, self._stored, counts)
        self._active, self._weighted, self._population = fresh, True, fresh.count()
        self._cursor.reset()

    samples_metadata = get_metadata
    set_samples_metadata = update_metadata

    def plan(self, start: int, length: int) -> DataFrame:
        """(seq, active_pos) of a window of the stream."""
        if not self.config.shuffle:
            return sampling.sequential(self.spark, start, length, self._population)
        if not self._weighted:
            return sampling.uniform_draws(self.spark, self.config.seed, start, length, self._population)
        return sampling.weighted_draws(self._active, self.config.seed, start, length)

    def window(self) -> DataFrame:
        """The next window's samples as (seq, cache_id, sample_id, metadata, payload). Metadata is what was stored."""
        return self._emit(*self._cursor.reserve(self.config.shuffle, self._population))

    def _emit(self, start: int, length: int) -> DataFrame:
        rows = self.plan(start, length).join(self._active.select(A.POS, "cache_id", "sample_id"), A.POS)
        rows = rows.select("seq", "cache_id", "sample_id")
        found = self.samples.select("cache_id", "sample_id", *(f"`{c}`" for c in self.names), "payload")
        if length <= PRUNED_SAMPLES:
            picked = rows.collect()  # at most PRUNED_SAMPLES rows
            ids = sorted({r["sample_id"] for r in picked})
            rows = F.broadcast(self.spark.createDataFrame(picked, "seq long, cache_id long, sample_id long"))
            found = found.where(F.col("cache_id").isin(sorted({r["cache_id"] for r in picked})))
            found = found.where(F.col("sample_id").between(ids[0], ids[-1]) & F.col("sample_id").isin(ids)) if ids else found
        return rows.join(found, ["cache_id", "sample_id"])

    def __iter__(self) -> Iterator[CachedSample]:
        """The next window, a part of it at a time; closing the iterator cancels what it still has running."""
        rows = self.window()
        parts = math.ceil(len(self) / max(self.config.prefetch, LEAST_FETCHED))
        rows = rows.repartitionByRange(parts, "seq").sortWithinPartitions("seq") if parts > 1 else rows.coalesce(1).sortWithinPartitions("seq")
        names, context, tag = self.names, self.spark.sparkContext, f"drawwell-{uuid.uuid4().hex}"

        def samples():
            context.addJobTag(tag)
            try:
                fetched = rows.toLocalIterator(prefetchPartitions=True)
            finally:
                context.removeJobTag(tag)
            try:
                for r in fetched:
                    yield CachedSample(bytes(r["payload"]), {c: r[c] for c in names}, r["cache_id"], r["sample_id"])
            finally:
                context.cancelJobsWithTag(tag)

        return samples()

    def to_torch_iterable_dataset(self):
        """A sized view for torch's DataLoader, for use without workers of its own."""
        from torch.utils.data import IterableDataset, get_worker_info

        outer = self

        class View(IterableDataset):
            def __len__(self):
                return len(outer)

            def __iter__(self):
                if get_worker_info() is not None:
                    raise RuntimeError("use num_workers=0: samples come from Spark")
                return iter(outer)

        return View()


class DatasetRuntime:
    """Owner of a session. num_workers is how many sources are written at a time."""

    def __init__(self, num_workers: int, spark: SparkSession | None = None):
        if not isinstance(num_workers, int) or num_workers <= 0:
            raise InvalidInput("num_workers must be greater than zero")
        self.num_workers = num_workers
        self.spark = spark or SparkSession.builder.getOrCreate()

    def write_cache(self, sources, path: str, config: WriterConfig | None = None) -> list[CacheWriteSuccess | CacheWriteError]:
        """Write one source or several; a result for each, in the order given."""
        done = write_cache(self.spark, sources, path, config, self.num_workers)
        return done if isinstance(done, list) else [done]

    def cached_dataset(self, paths, config: ReaderConfig) -> CachedDataset:
        return CachedDataset(self.spark, [paths] if isinstance(paths, str) else list(paths), config)

    def from_cache_sources(self, sources: list, path: str, reader: ReaderConfig, writer: WriterConfig | None = None) -> CacheSourcesDatasetSuccess | CacheSourcesDatasetError:
        """A dataset of all sources that could be written or were there, with the results of all."""
        results = self.write_cache(list(sources), path, writer)
        good = [r for r in results if isinstance(r, CacheWriteSuccess)]
        if not good:
            return CacheSourcesDatasetError(results, "; ".join(f"{r.source_name}: {r.message}" for r in results) or "no sources")
        return CacheSourcesDatasetSuccess(self.cached_dataset([r.path for r in good], reader), results)
