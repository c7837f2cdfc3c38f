"""Cleaning of blocks and metadata, label lines, field manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_of, value_of


def rebuild(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``text`` of each document from its kept lines (``pos``, ``line``), joined by newlines."""
    held = lines.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return held.select(id_col, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def normalise_metadata(raw: Column, types: tuple[str, ...], scopes: tuple[str, ...], most: int = 8) -> Column:
    """struct(doc_type, keywords, scope, cross_refs) of JSON metadata; defaults where it is no object.

    Unknown types become the last of ``types``; scopes outside ``scopes`` go, and none
    left means the last of them; at most ``most`` keywords stay.
    """
    x = F.from_json(raw, "struct<doc_type:string,keywords:array<string>,applicable_scope:array<string>,cross_refs:array<string>>")
    none = F.array().cast("array<string>")
    scope = F.filter(F.coalesce(x["applicable_scope"], none), lambda s: s.isin(*scopes))
    return F.struct(
        F.when(x["doc_type"].isin(*types), x["doc_type"]).otherwise(types[-1]).alias("doc_type"),
        F.slice(F.coalesce(x["keywords"], none), 1, most).alias("keywords"),
        F.when(F.size(scope) > 0, scope).otherwise(F.array(F.lit(scopes[-1]))).alias("scope"),
        F.coalesce(x["cross_refs"], none).alias("cross_refs"),
    )


def label_lines(works: DataFrame, labels: tuple[str, ...], id_col: str = "work") -> DataFrame:
    """``label``, ``value``, ``pos``, ``line`` of the ``label: value`` lines of ``content`` whose label is in ``labels``."""
    lines = works.select(id_col, F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    parsed = lines.select(id_col, "pos", "line", label_of(F.col("line")).alias("label"), value_of(F.col("line")).alias("value"))
    return parsed.where(F.col("label").isin(*labels) & F.col("value").isNotNull())


def manifest_problems(entries: DataFrame, works: DataFrame, fields: tuple[str, ...], drafts: bool = False) -> DataFrame:
    """``source_id``, ``problem``: what is wrong with search-field entries; accepted ones give no row."""
    twice = entries.groupBy("source_id", "field").agg(F.count("*").alias("n")).where("n > 1").select("source_id", "field", F.lit(True).alias("twice"))
    e = entries.join(twice, ["source_id", "field"], "left").join(works.select(F.col("work").alias("source_id"), F.col("source_hash").alias("now"), "content"), "source_id", "left")
    checks = (
        ("duplicate", F.col("twice")), ("unknown work", F.col("content").isNull()), ("stale work", F.col("now") != F.col("source_hash")),
        ("unknown field", ~F.col("field").isin(*fields)), ("empty text", F.trim("text") == ""), ("missing quote", (F.size("quotes") == 0) | F.exists("quotes", lambda q: ~F.contains(F.col("content"), q))),
        ("missing derivation", F.coalesce(F.trim("derivation"), F.lit("")) == ""), ("unknown status", ~F.col("review_status").isin("draft", "reviewed")),
        ("draft", (F.col("review_status") == "draft") & F.lit(not drafts)),
    )
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks]))
    return e.select("source_id", F.explode(found).alias("problem"))


def extend_fields(fields: DataFrame, words: DataFrame, negation: str = r"(?i)\b(not|without|no)\b", most: int = 10_000) -> DataFrame:
    """Translations of the dictionary phrases that a field contains, in dictionary order; negated texts are skipped.

    ``words`` (phrase, translation, place) is a dictionary of at most ``most`` rows.
    """
    if words.limit(most + 1).count() > most:
        raise ValueError("the dictionary is too large to broadcast")
    hits = fields.where(~F.col("text").rlike(negation)).join(F.broadcast(words), F.expr("contains(text, phrase)"))
    listed = hits.groupBy("work").agg(F.array_sort(F.collect_set(F.struct("place", "translation"))).alias("t"))
    return listed.select("work", F.array_join(F.transform("t", lambda x: x["translation"]), " ").alias("text"))
