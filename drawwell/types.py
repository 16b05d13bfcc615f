"""Configurations, results and errors. Configurations are frozen and reject what they can't mean."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields
from typing import TYPE_CHECKING, NamedTuple

if TYPE_CHECKING:
    from drawwell.runtime import CachedDataset


class InvalidInput(ValueError):
    """An input, a configuration or a cache that can't be used."""


class Strict:
    """A base of configurations: an option that doesn't exist is an invalid input."""

    def __new__(cls, *args, **options):
        if unknown := sorted(set(options) - {f.name for f in fields(cls)}):
            raise InvalidInput(f"{cls.__name__} has no option '{unknown[0]}'")
        return super().__new__(cls)


def _positive(name: str, value: int) -> None:
    if not isinstance(value, int) or isinstance(value, bool) or value <= 0:
        raise InvalidInput(f"{name} must be greater than zero")


@dataclass(frozen=True)
class ShardCompression(Strict):
    """lz4 or none. ratio says how much smaller the payloads are expected to get; shards are packed by it, so that their
    files come near the limit."""

    algorithm: str = "none"
    ratio: float = 1.0

    def __post_init__(self):
        if self.algorithm not in ("none", "lz4"):
            raise InvalidInput(f"unknown compression algorithm '{self.algorithm}'")
        if not math.isfinite(self.ratio) or self.ratio <= 0 or (self.algorithm == "none" and self.ratio != 1.0):
            raise InvalidInput("compression ratio must be finite and positive, and 1.0 without compression")

    @property
    def codec(self) -> str:
        return {"none": "none", "lz4": "lz4_raw"}[self.algorithm]


@dataclass(frozen=True)
class WriterProfilerConfig(Strict):
    """Where the report of a write goes: calls, time and bytes by source and stage, as JSON."""

    path: str

    def __post_init__(self):
        if not isinstance(self.path, str) or not self.path:
            raise InvalidInput("the profiler needs a path")


@dataclass(frozen=True)
class WriterConfig(Strict):
    """prefetch: thousands of samples of an iterable that the driver holds at most before it writes them."""

    max_shard_bytes: int = 64 << 20
    prefetch: int = 64
    compression: ShardCompression = ShardCompression()
    show_progress: bool = True
    validate_cache: bool = False
    profiler: WriterProfilerConfig | None = None

    def __post_init__(self):
        _positive("max_shard_bytes", self.max_shard_bytes)
        _positive("prefetch", self.prefetch)


@dataclass(frozen=True)
class ReaderConfig(Strict):
    """prefetch: samples that are fetched at once while a dataset is iterated, a thousand at least."""

    seed: int
    prefetch: int = 64
    shuffle: bool = True
    validate_cache: bool = False

    def __post_init__(self):
        _positive("prefetch", self.prefetch)


class CacheWriteSuccess(NamedTuple):
    source_name: str
    path: str
    reused: bool


class CacheWriteError(NamedTuple):
    source_name: str
    message: str


class CacheSourcesDatasetSuccess(NamedTuple):
    """A dataset of the sources that have a cache, and how it went with each."""

    dataset: CachedDataset
    results: list[CacheWriteSuccess | CacheWriteError]


class CacheSourcesDatasetError(NamedTuple):
    """No source has a cache: how it went with each, and why in one line."""

    results: list[CacheWriteSuccess | CacheWriteError]
    message: str


class CachedSample(NamedTuple):
    data: bytes
    metadata: dict
    cache_id: int
    sample_id: int
