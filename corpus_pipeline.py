"""The corpus pipeline: each stage is one operator of drawwell.llm at work on what its predecessor kept.

Every stage but the last returns the columns of documents. Toxicity drops what it predicts as toxic; near-dedup keeps one
document of each group; decontamination drops documents that hold a benchmark window; the secret scan keeps all documents
and replaces each secret by [secret], with n_chars counted anew; mixing gives what the mix takes of each document.

Defined cases: a null text is kept as long as its score of the model's bias is below 0.5, is a near-duplicate of all texts
with fingerprint zero (empty ones among them), holds no benchmark window and no secret, and has size 0 in the mix; a text
without secrets keeps its n_chars, null or not. Of near-duplicates the least doc_id stays (null last), of equal ids the
least hash of the text; rows repeated in doc_id and text stay once. A document with another's doc_id and another text is
judged on its own. Columns beside those of documents go along unchanged up to the mix, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawwell.llm.common import stored, table, unused
from drawwell.llm.decontaminate import contamination
from drawwell.llm.mixing import mix_sources
from drawwell.llm.secret_scan import redact_secrets
from drawwell.llm.simhash import one_of_each
from drawwell.llm.toxicity import fold_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fold_model(spark, docs, sf_dir)
    return docs.where(model.score(spark, F.col("text")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    own, tie = unused("__id", docs.columns), unused("__tie", docs.columns)
    bad = stored(found.where("contaminated").select(F.col("doc_id").alias(own), F.col("tie").alias(tie)).distinct(), "contaminated")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(tie)), "left_anti")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = unused("__clean", docs.columns)
    clean = docs.withColumn(name, redact_secrets("text"))
    changed = ~F.col("text").eqNullSafe(F.col(name))
    counted = F.when(changed, F.char_length(name).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    renewed = {"text": F.col(name).alias("text"), "n_chars": counted}
    return clean.select(*(renewed.get(c, F.col(f"`{c}`")) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs.select("doc_id", "text", "source")).documents.drop("source")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact),
    ("mixing", mix),
]

#: Hashes of shingles, fitted weights and pseudorandom draws have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
