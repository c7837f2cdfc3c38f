"""Checks of claims against sources."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import stored
from .cleaning import label_lines


def claim_issues(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims (claim, source, quote) with an ``issue``: unknown source, or the quote is not in it."""
    both = claims.join(sources.select("source", "content"), "source", "left")
    issue = F.when(F.col("content").isNull(), "unknown_source").when(~F.contains("content", "quote"), "quote_not_in_source")
    return both.select("claim", issue.alias("issue")).where("issue is not null")


def fact_issues(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts (fact, source, quote, value) with an ``issue``; a value must stand in its quote."""
    both = facts.join(sources.select("source", "content"), "source", "left")
    issue = F.when(F.col("content").isNull(), "unknown_source").when(~F.contains("content", "quote"), "quote_not_in_source").when(~F.contains("quote", "value"), "value_not_in_quote")
    return both.select("fact", issue.alias("issue")).where("issue is not null")


def is_bare_place(quote: Column) -> Column:
    """A single line that begins with ``place:``."""
    lines = F.filter(F.transform(F.split(quote, "\n"), strip), lambda x: x != "")
    return (F.size(lines) == 1) & F.startswith(F.lower(lines[0]), F.lit("place:"))


def merged_spans(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """``source``, ``start``, ``stop``: the first places of quotes (source, quote), merged where they overlap or only white space parts them."""
    both = quotes.select("source", "quote").distinct().join(sources.select("source", "content"), "source")
    at = both.select("source", "content", (F.instr("content", F.col("quote")) - 1).alias("start"), F.length("quote").alias("n")).where("start >= 0")
    spans = at.select("source", "content", "start", (F.col("start") + F.col("n")).alias("stop"))
    w = Window.partitionBy("source").orderBy("start", "stop")
    seen = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.expr("substring(content, int(seen + 1), int(start - seen))")
    rows = spans.withColumn("seen", seen).withColumn("new", F.col("seen").isNull() | ((F.col("start") > F.col("seen")) & (F.trim(F.regexp_replace(gap, r"\s", "")) != "")))
    island = F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("island", island).groupBy("source", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each (id, quote, span): whether the span holds the quote, and the stretches that the span's places in the quote cover."""
    for batch in batches:
        ids, inside, start, stop = [], [], [], []
        for k, (quote, span) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            within = span is not None and quote is not None and quote in span
            found: list[list[int]] = []
            at = quote.find(span) if span and quote else -1
            while at >= 0:
                if found and at <= found[-1][1]:
                    found[-1][1] = at + len(span)
                else:
                    found.append([at, at + len(span)])
                at = quote.find(span, at + 1)
            for a, b in found or [(None, None)]:
                ids.append(k)
                inside.append(within)
                start.append(a)
                stop.append(b)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(inside, pa.bool_()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=["id", "inside", "start", "stop"])


def covered_quotes(quotes: DataFrame, spans: DataFrame) -> DataFrame:
    """Quotes (id, source, quote) with ``covered``: inside one selected span (source, span), or every character but white space
    in some place of one.

    Places are stretches, joined where they touch; what is left between them is looked at, so rows
    grow with the places, not with the characters.  A quote of white space only is not covered.
    """
    kind = dict(quotes.dtypes)["id"]
    both = quotes.join(spans, "source", "left").select("id", "quote", "span")
    places = stored(both.mapInArrow(_places, f"id {kind}, inside boolean, start long, stop long"), "places")
    inside = places.groupBy("id").agg(F.max("inside").alias("inside"), F.max("stop").alias("last"))
    before = Window.partitionBy("id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    gaps = places.where("start is not null").select("id", F.coalesce(F.max("stop").over(before), F.lit(0)).alias("from"), F.col("start").alias("to")).where("to > from")
    whole = quotes.select("id", "quote").join(inside, "id")
    tails = whole.select("id", F.coalesce("last", F.lit(0)).alias("from"), F.length("quote").cast("long").alias("to"))
    parts = gaps.unionByName(tails).join(quotes.select("id", "quote"), "id")
    rest = F.expr("substring(quote, int(from + 1), int(to - from))")
    open_ = parts.where(rest.rlike(r"\S")).select("id").distinct().withColumn("open", F.lit(True))
    return whole.join(open_, "id", "left").select("id", ((F.trim("quote") != "") & (F.col("inside") | F.col("open").isNull())).alias("covered"))


def uncited(compared: Column, cited: Column) -> Column:
    """Compared sources that no claim cites."""
    return F.array_except(compared, cited)


def review_passes(reviews: DataFrame) -> DataFrame:
    """Reviews (draft, n, index, supported, answered, identity): ``passed`` if the indexes are exactly 0..n-1 and all hold."""
    held = reviews.groupBy("draft", "n").agg(F.array_sort(F.collect_list("index")).alias("seen"), F.bool_and(F.col("supported") & F.col("answered") & F.col("identity")).alias("good"))
    want = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    return held.select("draft", (F.col("good") & (F.col("seen") == want)).alias("passed"))


def field_answers(questions: DataFrame, works: DataFrame, patterns: dict[str, str], labels: dict[str, str], most: int = 200) -> DataFrame:
    """Whole questions (question, text, work, hash) for one field, answered by the only line of that label of an unchanged active work."""
    kind = F.lit(None).cast("string")
    for name, pattern in patterns.items():
        kind = F.when(F.col("text").rlike(f"(?i)^{pattern}[?？]?$"), name).otherwise(kind)
    label = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    asked = questions.withColumn("field", kind).where("field is not null").withColumn("label", F.element_at(label, F.col("field")))
    ok = works.where("status = 'active'").select("work", F.col("hash").alias("now"), "content")
    lines = label_lines(ok, tuple(labels.values())).groupBy("work", "label").agg(F.count("*").alias("n"), F.first("value").alias("value")).where("n = 1")
    both = asked.join(ok.select("work", "now"), "work").where("hash = now").join(lines, ["work", "label"])
    return both.where(F.length("value") <= most).select("question", "field", "value")


def field_audit(works: DataFrame, labels: dict[str, str]) -> DataFrame:
    """``field``, ``answerable``: works with exactly one line of the field's label."""
    n = label_lines(works, tuple(labels.values())).groupBy("work", "label").agg(F.count("*").alias("n")).where("n = 1").groupBy("label").agg(F.count("*").alias("answerable"))
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair[::-1]])
    return n.select(F.element_at(names, F.col("label")).alias("field"), "answerable")


def citations(hits: DataFrame, chunks: DataFrame, docs: DataFrame, chars: int = 200) -> DataFrame:
    """Hits (answer, chunk) as citations with a snippet; a missing title is filled from the document."""
    full = hits.join(chunks, "chunk").join(docs.select("doc", F.col("title").alias("doc_title")), "doc", "left")
    return full.select("answer", "chunk", "doc", F.coalesce("title", "doc_title").alias("title"), F.substring("text", 1, chars).alias("snippet"))


def extractive(hits: DataFrame, k: int = 3, chars: int = 300) -> DataFrame:
    """The first ``k`` texts of an answer, each cut to ``chars``."""
    first = hits.withColumn("k", F.row_number().over(Window.partitionBy("answer").orderBy("rank", "chunk"))).where(F.col("k") <= k)
    held = first.groupBy("answer").agg(F.array_sort(F.collect_list(F.struct("k", F.substring("text", 1, chars).alias("x")))).alias("l"))
    return held.select("answer", F.array_join(F.transform("l", lambda x: x["x"]), "\n").alias("text"))


def merged_answers(parts: DataFrame) -> DataFrame:
    """Department answers (request, dept, text, cites, confidence; null text: none) as labelled sections with all citations."""
    ok = F.col("text").isNotNull()
    held = parts.groupBy("request").agg(
        F.array_sort(F.collect_list(F.when(ok, F.struct("dept", "text")))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(ok, F.col("cites")))))).alias("cites"),
        F.round(F.avg(F.when(ok, F.col("confidence"))), 6).alias("confidence"), F.bool_or(~ok).alias("partial"),
    )
    text = F.array_join(F.transform("s", lambda x: F.concat(F.lit("["), x["dept"], F.lit("] "), x["text"])), "\n\n")
    return held.select("request", text.alias("text"), "cites", F.transform("s", lambda x: x["dept"]).alias("depts"), "confidence", "partial")


def heuristic_score(text: Column, n_citations: Column) -> Column:
    """1 less 0.3 for each of: no citation, empty answer."""
    return F.round(1.0 - 0.3 * (n_citations == 0).cast("int") - 0.3 * (F.trim(F.coalesce(text, F.lit(""))) == "").cast("int"), 6)


def valid_scripts(scripts: DataFrame, works: DataFrame) -> DataFrame:
    """Scripts (script, work, status, source_hash, content_hash, draft_hash, quotes, passed) that may be used: ``valid``."""
    both = scripts.join(works.select("work", F.col("hash").alias("now"), "content"), "work", "left")
    ok = (F.col("status") == "ready") & (F.col("source_hash") == F.col("now")) & (F.col("content_hash") == F.col("draft_hash")) & F.col("passed") & F.forall("quotes", lambda q: F.contains(F.col("content"), q))
    return both.select("script", F.coalesce(ok, F.lit(False)).alias("valid"))
