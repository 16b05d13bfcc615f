"""Sources: a name and rows of a payload with primitive metadata."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawwell.types import InvalidInput

RESERVED = ("cache_id", "sample_id", "weight", "active_pos", "payload", "payload_sha256", "record_sha256", "shard_id", "byte_len")
KINDS = {"boolean": "bool", "bigint": "int", "double": "float", "string": "string"}
#: Samples, and bytes of payload, that the driver holds of an iterable before it writes them; samples per unit of prefetch.
_CHUNK, _CHUNK_BYTES = 1024, 64 << 20


@dataclass(frozen=True)
class FrameSource:
    """A source made of a DataFrame with a binary payload column; order_by gives the order of arrival."""

    name: str
    frame: DataFrame
    order_by: tuple[str, ...] = field(default=())


def check_name(name) -> str:
    if not isinstance(name, str) or not name or name in (".", "..", "tmp") or "/" in name or "\\" in name:
        raise InvalidInput(f"source name must be one normal path segment, not {name!r}")
    return name


def kind_of(value) -> str:
    """bool before int, since True is an int; whole numbers past 64 bits are floats."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint" if -(1 << 63) <= value < 1 << 63 else "double"
    if isinstance(value, float):
        return "double"
    if isinstance(value, str):
        return "string"
    raise InvalidInput(f"metadata values must be bool, int, float or str, not {type(value).__name__}")


def check_schema(schema: T.StructType) -> list[str]:
    """Metadata columns of a source frame, in alphabetical order."""
    if "payload" not in schema.names or not isinstance(schema["payload"].dataType, T.BinaryType):
        raise InvalidInput("a source needs a binary column 'payload'")
    names = sorted(c for c in schema.names if c != "payload")
    if not names:
        raise InvalidInput("metadata must have at least one field")
    for c in names:
        if c in RESERVED or c.startswith("__") or "`" in c:
            raise InvalidInput(f"metadata field '{c}' is reserved")
        if schema[c].dataType.simpleString() not in KINDS:
            raise InvalidInput(f"metadata field '{c}' must be bool, int, float or string")
    return names


def _row(item) -> tuple[bytes, dict]:
    if not isinstance(item, tuple) or len(item) != 2:
        raise InvalidInput("a source must yield (data, metadata) pairs")
    data, metadata = item
    if not isinstance(data, bytes | bytearray | memoryview):
        raise InvalidInput("sample data must be bytes-like")
    if not isinstance(metadata, Mapping) or not all(isinstance(k, str) for k in metadata):
        raise InvalidInput("sample metadata must be a mapping with string keys")
    return bytes(data), dict(metadata)


def frame_of(spark: SparkSession, items: Iterable, staged: str, prefetch: int = 64) -> DataFrame | None:
    """A frame with column __seq of what an iterable yields; None if it yields nothing. Full chunks are written to the
    staging folder, so the driver holds one at a time; an iterable of less than a chunk is never written.

    The first sample fixes the names and kinds of the metadata; there is no widening.
    """
    kinds: dict[str, str] | None = None
    rows, seq, size, written, schema = [], 0, 0, False, ""

    def flush():
        nonlocal size, written
        spark.createDataFrame(rows, schema).write.mode("append").parquet(staged)
        rows.clear()
        size, written = 0, True

    for item in items:
        data, metadata = _row(item)
        own = {k: kind_of(metadata[k]) for k in sorted(metadata)}
        if kinds is None:
            kinds = own
            schema = ", ".join(["__seq long", "payload binary", *(f"`{c}` {k}" for c, k in kinds.items())])
            check_schema(T.StructType([T.StructField("payload", T.BinaryType()), *(T.StructField(c, T._parse_datatype_string(k)) for c, k in kinds.items())]))
        if own != kinds:
            raise InvalidInput(f"metadata of sample {seq} does not match the schema of the first sample")
        rows.append((seq, bytearray(data), *(float(metadata[c]) if k == "double" else metadata[c] for c, k in kinds.items())))
        seq, size = seq + 1, size + len(data)
        if len(rows) >= _CHUNK * prefetch or size >= _CHUNK_BYTES:
            flush()
    if not written:
        return spark.createDataFrame(rows, schema) if rows else None
    if rows:
        flush()
    return spark.read.schema(schema).parquet(staged)


def source_frame(spark: SparkSession, source, staged: str, prefetch: int = 64) -> tuple[DataFrame | None, list[str]]:
    """The rows of a source, and the columns that order them."""
    if isinstance(source, FrameSource):
        names = check_schema(source.frame.schema)
        nulls = source.frame.agg(*(F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in ["payload", *names])).first()
        if bad := [c for c in ["payload", *names] if nulls[c]]:
            raise InvalidInput(f"source column '{bad[0]}' contains null")
        return source.frame, list(source.order_by) or names
    return frame_of(spark, source, staged, prefetch), ["__seq"]
