"""The folder that driver and executors share, and small files in any store that Spark reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="drawwell-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """df as it is now: written once, read back, independent of what it was made from."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Hadoop's file system behind a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def rename(self, old: str, new: str) -> bool:
        return self.fs.rename(self.path(old), self.path(new))

    def write(self, path: str, text: str) -> None:
        out = self.fs.create(self.path(path), False)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def lengths(self, path: str) -> dict[str, int]:
        """Parquet files below a folder, by their paths in it, with their lengths."""
        out, top = {}, self.fs.makeQualified(self.path(path)).toString().rstrip("/") + "/"
        files = self.fs.listFiles(self.path(path), True)
        while files.hasNext():
            s = files.next()
            if (name := s.getPath().toString()).endswith(".parquet"):
                out[name.removeprefix(top)] = s.getLen()
        return out
