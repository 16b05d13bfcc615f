"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and a write and a read of 10,000 samples of 1,024 bytes;
medians of three runs in a warm session; prints one JSON line."""

import json
import os
import statistics
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from drawwell.operators.active import class_balanced
from drawwell.plans.queries import QUERIES
from drawwell.runtime import DatasetRuntime
from drawwell.sources.inputs import FrameSource
from drawwell.sources.shared import shared_dir
from drawwell.types import ReaderConfig, WriterConfig

HEADLINE = ["materialise_samples", "materialise_weighted", "class_balance_weights", "weighted_draws", "uniform_draws", "index_table", "payload_sha256"]
SAMPLES, BYTES = 10_000, 1024


def smoke(spark: SparkSession) -> dict[str, float]:
    """Seconds of a write with load, of an epoch in order, of a balancing update, and of drawn epochs before and after."""
    runtime, took = DatasetRuntime(4, spark), {}
    rows = spark.range(SAMPLES).select(F.col("id").alias("index"), F.lit("train").alias("split"), F.repeat(F.lit("x"), BYTES).cast("binary").alias("payload"))

    def timed(name, work):
        began = time.perf_counter()
        out = work()
        took[name] = time.perf_counter() - began
        return out

    def epoch(data):
        total = data.window().agg(F.sum(F.octet_length("payload"))).first()[0]
        assert total == SAMPLES * BYTES

    def written():
        done = runtime.write_cache(FrameSource("synthetic", rows, ("index",)), f"{shared_dir(spark)}/bench-{uuid.uuid4().hex}", WriterConfig(show_progress=False))
        return done[0], runtime.cached_dataset(done[0].path, ReaderConfig(seed=42, shuffle=False))

    done, data = timed("smoke_write", written)
    timed("smoke_epoch", lambda: epoch(data))
    drawn = runtime.cached_dataset(done.path, ReaderConfig(seed=42))
    timed("smoke_uniform_epoch", lambda: epoch(drawn))
    timed("smoke_update", lambda: drawn.update_metadata(class_balanced(drawn.get_metadata(), "split")))
    timed("smoke_weighted_epoch", lambda: epoch(drawn))
    return took


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs), 3)
    total = round(sum(took.values()), 3)
    runs = [smoke(spark) for _ in range(3)]
    took |= {k: round(statistics.median(r[k] for r in runs), 3) for k in runs[0]}
    rates = {"write_samples_per_second": round(SAMPLES / took["smoke_write"]), "read_samples_per_second": round(SAMPLES / took["smoke_epoch"])}
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": took, "sf": sf, **rates}))


if __name__ == "__main__":
    main()
