"""Routing of queries to lanes and departments; relations and clusters of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import date_text, identifier_key, name_key, overlap, strip, tokens, value_of, without_words
from ..session import stored
from .expand import expanded, tasks_for

#: Rows that a dictionary may have to be broadcast.
MOST_WORDS = 10_000


def small(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """``words`` marked for broadcast after its size is checked."""
    if words.limit(most + 1).count() > most:
        raise ValueError(f"a dictionary of more than {most} rows cannot be broadcast")
    return F.broadcast(words)


def line_lookup(photos: DataFrame, index: DataFrame, semantic: DataFrame, prefix: str) -> DataFrame:
    """``query``, ``work``, ``route``, ``lane``: works whose identifier is a whole line of the text (``prefix`` cut off), then the semantic ones.

    Only a query that reads more than one key of ``index`` can meet a work twice; the works of the others are told where they are met.
    """
    lines = photos.select("query", F.explode(F.split("text", "\n")).alias("line"))
    keys = lines.select("query", identifier_key(F.regexp_replace("line", prefix, "")).alias("key")).where("key is not null").distinct()
    index = stored(index.select("key", F.explode("works").alias("work")), "index")
    read = keys.join(index.select("key").distinct(), "key", "left_semi").groupBy("query").agg(F.collect_list("key").alias("keys"))
    read = stored(read, "read")
    works = lambda some: expanded(some.select("query", F.explode("keys").alias("key")), index, ["key"]).select("query", "work")
    exact = works(read.where(F.size("keys") == 1)).unionByName(works(read.where(F.size("keys") > 1)).distinct())
    exact = exact.select("query", "work", F.lit("identifier").alias("route"), F.lit(0).alias("lane"))
    return exact.unionByName(semantic.select("query", "work", F.lit("semantic").alias("route"), F.lit(1).alias("lane")))


def homonym_order(named: DataFrame, ranked: DataFrame) -> DataFrame:
    """Named works (query, doc) in the order of an earlier ranking, the rest after."""
    both = named.join(ranked.select("query", "doc", F.col("rank").alias("was")), ["query", "doc"], "left")
    order = Window.partitionBy("query").orderBy(F.col("was").asc_nulls_last(), "doc")
    return both.select("query", "doc", F.row_number().over(order).alias("rank"))


def metadata_lookup(queries: DataFrame, index: DataFrame, uncertain: str, negation: str = r"(?i)\b(not|except|without|and|or)\b") -> DataFrame:
    """``query``, ``kind``, ``key``, ``work``: whole questions for a date or a maker, looked up in a label index."""
    text = F.regexp_replace(strip(F.col("text")), r"[.!?。！？]+$", "")
    dated = F.regexp_extract(text, r"(?i)^find (?:works|objects) dated\s+(.+)$", 1)
    made = F.regexp_extract(text, r"(?i)^find (?:works|objects) by\s+(.+)$", 1)
    name = F.when(made != "", F.array_join(name_key(made, uncertain), " "))
    # A question is one or the other, so a date comes first only where there is one.
    parsed = queries.repartition(4 * tasks_for(queries)).where(~F.col("text").rlike(negation)).select("query", date_text(dated).alias("date"), name.alias("author"))
    parsed = parsed.select("query", F.inline(F.array(F.struct(F.when(F.col("date").isNotNull(), "date").otherwise("author").alias("kind"), F.coalesce("date", "author").alias("key"))))).where("key is not null")
    return expanded(parsed, index.select("kind", "key", "work"), ["kind", "key"]).select("query", "kind", "key", "work")


def prefer_material(hits: DataFrame, label: str, uncertain: str) -> DataFrame:
    """Hits (query, doc, pos, content, material): rows whose every line of ``label`` names the material, surely, come first; none goes."""
    lines = F.filter(F.split("content", "\n"), lambda x: F.startswith(x, F.lit(f"{label}:")))
    fits = F.forall(lines, lambda x: (F.lower(value_of(x)) == F.lower(F.col("material"))) & ~x.rlike(f"(?i)\\b({uncertain})\\b"))
    marked = hits.withColumn("promoted", (F.size(lines) > 0) & fits)
    order = Window.partitionBy("query").orderBy(F.desc("promoted"), "pos")
    return marked.select("query", "doc", "promoted", F.row_number().over(order).alias("rank"))


def expand_glossary(queries: DataFrame, words: DataFrame, negation: str, least: int = 2) -> DataFrame:
    """``query``, ``concepts``, ``applied``, ``expanded``: translations are added where at least ``least`` concepts occur and nothing is negated."""
    hits = queries.where(~F.col("text").rlike(negation)).join(small(words), F.expr("contains(lower(text), phrase)"))
    found = hits.groupBy("query").agg(F.count_distinct("translation").cast("int").alias("n"), F.array_sort(F.collect_set(F.struct("place", "translation"))).alias("t"))
    both = queries.join(found, "query", "left")
    n = F.coalesce("n", F.lit(0))
    more = F.array_join(F.array_distinct(F.transform("t", lambda x: x["translation"])), " ")
    return both.select("query", n.alias("concepts"), (n >= least).alias("applied"), F.when(n >= least, F.concat_ws(" ", "text", more)).otherwise(F.col("text")).alias("expanded"))


def expand_synonyms(queries: DataFrame, words: DataFrame) -> DataFrame:
    """Every query, and once more with the synonyms it lacks of the terms it has."""
    hits = queries.join(small(words), F.expr("contains(text, phrase) and not contains(text, translation)"))
    more = hits.groupBy("query").agg(F.array_sort(F.collect_set(F.struct("place", "translation"))).alias("t"))
    longer = queries.join(more, "query").select("query", F.concat_ws(" ", "text", F.array_join(F.transform("t", lambda x: x["translation"]), " ")).alias("text"), F.lit(1).alias("variant"))
    return queries.select("query", "text", F.lit(0).alias("variant")).unionByName(longer)


def coverage_gate(hits: DataFrame, function_words: tuple[str, ...], least: float = 0.5) -> DataFrame:
    """Hits (query, doc, text, content): the best share of a query's content words in one hit decides for the field lane."""
    words = F.filter(without_words(F.array_distinct(tokens(F.col("text"))), function_words), lambda w: F.length(w) >= 2)
    share = F.when(F.size(words) > 0, overlap(words, tokens(F.col("content")))).otherwise(0.0)
    best = hits.select("query", "doc", F.round(share, 6).alias("coverage")).groupBy("query").agg(F.max("coverage").alias("coverage"), F.max_by("doc", F.struct("coverage", -F.col("doc"))).alias("doc"))
    return best.withColumn("field_lane", F.col("coverage") >= least)


def bridge(quotes: DataFrame, chunks: DataFrame, width: int = 1000) -> DataFrame:
    """The chunk (work, chunk, start, stop) of each work that shares most with its quotes (work, start, stop, weight).

    Positions are dealt to bins of ``width``, so that a quote meets the chunks near it only; a pair
    counts in the first bin that both reach.
    """
    first = lambda c: F.floor(F.col(c) / width)
    dealt = lambda df: df.where("stop > start").withColumn("bin", F.explode(F.sequence(first("start"), F.floor((F.col("stop") - 1) / width))))
    both = dealt(quotes).alias("q").join(dealt(chunks).alias("c"), ["work", "bin"]).where(F.col("bin") == F.greatest(first("q.start"), first("c.start")))
    shared = F.least("q.stop", "c.stop") - F.greatest("q.start", "c.start")
    rows = both.select("work", "chunk", shared.alias("shared"), "weight").where("shared > 0")
    order = Window.partitionBy("work").orderBy(F.desc(F.col("shared") * F.col("weight")), "chunk")
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k", "weight")


def first_hits(hits: DataFrame, active: DataFrame, k: int) -> DataFrame:
    """The first hit of each document over variants of a query, active ones only, by score."""
    one = hits.join(active, "doc", "left_semi").groupBy("query", "doc").agg(F.min_by("score", F.struct("variant", "pos")).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def route_departments(queries: DataFrame, words: DataFrame) -> DataFrame:
    """``query``, ``depts``, ``reasons``, ``confidence``: departments with any keyword (dept, phrase, place) in the text; none means all."""
    hit = queries.join(small(words), F.expr("contains(text, phrase)")).groupBy("query", "dept").agg(F.min_by("phrase", "place").alias("reason"))
    held = hit.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("dept", "reason"))).alias("d"))
    every = words.agg(F.array_sort(F.collect_set("dept")).alias("every"))
    both = queries.join(held, "query", "left").crossJoin(F.broadcast(every))
    depts = F.transform("d", lambda x: x["dept"])
    confidence = F.when(F.col("d").isNull(), 0.3).otherwise(F.round(F.least(F.lit(0.95), 0.6 + 0.1 * F.size("d")), 2))
    return both.select("query", F.coalesce(depts, "every").alias("depts"), F.coalesce(F.transform("d", lambda x: x["reason"]), F.array().cast("array<string>")).alias("reasons"), confidence.alias("confidence"))


def first_test(rules, default: str) -> Column:
    """The name of the first rule (name, condition) that holds."""
    return reduce(lambda rest, rule: F.when(rule[1], F.lit(rule[0])).otherwise(rest), reversed(rules), F.lit(default))


def first_rule(text: Column, rules, default: str) -> Column:
    """The name of the first rule (name, words) of which the text contains a word."""
    return first_test([(name, reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])) for name, words in rules], default)


def longest(matches: DataFrame) -> DataFrame:
    """Of the phrases found in each query the longest; ties to the lesser entry."""
    order = Window.partitionBy("query").orderBy(F.desc(F.length("phrase")), "entry")
    return matches.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def triggered(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (rule, patterns, priority) any pattern of which a text contains, by priority."""
    each = small(rules.select("rule", "priority", F.explode("patterns").alias("phrase")))
    hit = queries.join(each, F.expr("contains(text, phrase)")).select("query", "rule", "priority").distinct()
    return hit.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("priority"), "rule")))


def cascade(lanes: list[DataFrame], k: int) -> DataFrame:
    """Each query is answered by its first lane (query, doc, pos) that has an answer.

    Later lanes only see the queries that earlier ones left: an anti-join cuts them.
    """
    done, out = None, None
    for n, lane in enumerate(lanes):
        rest = lane if done is None else lane.join(done, "query", "left_anti")
        rows = rest.withColumn("lane", F.lit(n))
        out = rows if out is None else out.unionByName(rows)
        seen = lane.select("query").distinct()
        done = seen if done is None else done.union(seen).distinct()
    order = Window.partitionBy("query").orderBy("pos", "doc")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "doc", "lane", "rank")
