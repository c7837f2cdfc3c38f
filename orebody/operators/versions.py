"""Exact duplicates, version chains, life cycle and references of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accepted(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New documents (doc, dept, hash, created_at) whose content their department does not have; of equal new ones the first."""
    fresh = new.join(stored.where("status <> 'deleted'").select("dept", "hash"), ["dept", "hash"], "left_anti")
    k = F.row_number().over(Window.partitionBy("dept", "hash").orderBy("created_at", "doc"))
    return fresh.withColumn("k", k).where("k = 1").drop("k")


def next_version(version):
    """Column: major.(minor + 1); what cannot be read becomes 1.0."""
    major, minor = F.try_element_at(F.split(version, r"\."), F.lit(1)), F.try_element_at(F.split(version, r"\."), F.lit(2))
    good = version.rlike(r"^[0-9]+\.[0-9]+$")
    return F.when(good, F.concat_ws(".", major, (minor.cast("int") + 1).cast("string"))).otherwise("1.0")


def chained(docs: DataFrame) -> DataFrame:
    """``version`` and ``supersedes`` of documents of one (dept, title), oldest first: 1.0, 1.1, ..."""
    w = Window.partitionBy("dept", "title").orderBy("created_at", "doc")
    return docs.select("*", F.concat(F.lit("1."), F.row_number().over(w) - 1).alias("version"), F.lag("doc").over(w).alias("supersedes"))


def activated(docs: DataFrame) -> DataFrame:
    """The newest ready document of each (dept, title) is active, earlier active ones are archived."""
    w = Window.partitionBy("dept", "title").orderBy(F.desc("created_at"), F.desc("doc"))
    newest = F.row_number().over(w)
    return docs.withColumn("k", newest).select("doc", "dept", "title", F.when(F.col("k") == 1, "active").otherwise("archived").alias("status"))


def searchable(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks of active documents."""
    return chunks.join(docs.where("status = 'active'").select("doc"), "doc", "left_semi")


def fresh(results: DataFrame, works: DataFrame) -> DataFrame:
    """Results (query, work, hash, pos) whose stored work is active and unchanged; repeated works once, in order."""
    now = works.where("status = 'active'").select("work", "hash")
    return results.join(now, ["work", "hash"]).groupBy("query", "work").agg(F.min("pos").alias("pos"))


def leaks(reference: DataFrame, test: DataFrame) -> DataFrame:
    """Items of ``test`` (item, hash) that ``reference`` has too."""
    return test.join(reference.select("hash"), "hash", "left_semi").select("item", "hash")
