"""A training corpus from ``documents``: filter, de-duplicate, decontaminate, redact, mix.

Each stage takes (spark, docs, sf_dir) and returns a table.  All but the last return the
columns of ``docs`` as they came; the last returns the mix.  A runner may write each
result and read it again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.llm import cube_mix, decontaminate, quality_cnn, secret_scan, simhash
from orebody.llm.storage import stored

LEAST_QUALITY = 0.3
NEAR = simhash.Near(whole=True)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores at least ``LEAST_QUALITY`` for label 1 of ``labels.quality``.

    Null texts are scored as empty ones.  The classifier learns from a bounded sample of
    the labelled rows of ``docs``; without labels of both kinds all rows stay.
    """
    net = quality_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_cnn.score(docs, net, into="__score")
    return scored.where(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the least id.

    Near copies link by ``NEAR``: all pairs of texts whose sets of five-word shingles have a similarity of 0.8 or more.
    """
    return simhash.keep_one(docs, near=NEAR)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by ``benchmark``."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their secrets replaced by a mark; ``n_chars`` follows where a text changed."""
    clean = secret_scan.redact(docs.withColumn("__was", F.col("text")))
    kind = docs.schema["n_chars"].dataType
    n = F.when(F.col("text").eqNullSafe(F.col("__was")), F.col("n_chars")).otherwise(F.length("text").cast(kind))
    return clean.withColumn("n_chars", n).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (``copies``) and how many words (``taken``)."""
    found = cube_mix.mix(docs, weights=(5, 2, 1), share=1.5, most=2.0).withColumnRenamed("id", "doc_id")
    return found.where("copies > 0")


STAGES = [
    ("quality_classifier", quality),
    ("simhash_dedup", near_duplicates),
    ("decontamination", benchmark_free),
    ("secret_scan", secrets),
    ("source_mix", mixed),
]
#: SQL cannot express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, applied to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
