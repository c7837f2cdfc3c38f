"""Reading, upserting, counting and comparing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def find(table: DataFrame, equal: dict, newest: str, limit: int, tie: str) -> DataFrame:
    """Rows equal to ``equal``, newest first, at most ``limit``."""
    for column, value in equal.items():
        table = table.where(F.col(column) == value)
    return table.orderBy(F.desc(newest), tie).limit(limit)


def upsert(base: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Whole rows of ``rows`` replace those of ``base`` with the same key; the latest by ``order`` counts."""
    last = rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__k = 1").drop("__k")
    return base.join(last.select(key), key, "left_anti").unionByName(last)


def insert_unique(base: DataFrame, rows: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(base with the new rows, the rejected rows): a key that is there, or came earlier, is never overwritten."""
    numbered = rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    new = numbered.where("__k = 1").drop("__k").join(base.select(key), key, "left_anti")
    rejected = numbered.where("__k > 1").drop("__k").unionByName(numbered.where("__k = 1").drop("__k").join(base.select(key), key, "left_semi"))
    return base.unionByName(new), rejected


def incremented(base: DataFrame, deltas: DataFrame, key: str) -> DataFrame:
    """Counters (key, n) after signed steps (key, delta); absent counters begin at 0."""
    moved = deltas.groupBy(key).agg(F.sum("delta").alias("d"))
    return base.join(moved, key, "full_outer").select(key, (F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("n"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """``name``, ``rows``, ``digest``: a digest that does not depend on the order of rows."""
    out = None
    for name, table in tables.items():
        h = F.xxhash64(F.to_json(F.struct(*sorted(table.columns))))
        row = table.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).alias("s"))
        row = row.select(F.lit(name).alias("name"), "rows", F.concat_ws(":", "x", "s").alias("digest"))
        out = row if out is None else out.unionByName(row)
    return out


def corpus_problems(works: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``work``, ``problem``) of repeated or inactive works, and the corpus hash.

    The hash is that of the sorted hashes of the parts' digests by their first three
    characters, each that of its sorted digests: groups of a bounded share of the parts, so
    no task holds all of them.
    """
    twice = works.groupBy("work").agg(F.count("*").alias("n")).where("n > 1").select("work", F.lit("duplicate").alias("problem"))
    dead = works.where("status <> 'active'").select("work", F.lit("inactive").alias("problem"))
    joined = lambda: F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ""), 256)
    groups = parts.groupBy(F.substring("digest", 1, 3).alias("first")).agg(joined().alias("digest"))
    digest = groups.agg(joined().alias("corpus_hash"))
    return twice.unionByName(dead), digest
