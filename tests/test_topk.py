"""Document-partitioned scoring against plain loops and against the joins."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orebody.operators import retrieve, topk
from orebody.operators.index import term_index


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weigh = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weigh, k=rng.choice([0, 1, 5, 40]))), f"s{rng.choice([1, 1, 1, 2, 3])}") for i in range(n)]
    return rows + [(n, None, None), (n + 1, "w3 w50 w50", None)]


def loops(rows, queries, k, within=False, k1=1.5, b=0.75):
    out = []
    texts = [(d, (t or "").split(), s if within else 0) for d, t, s in rows]
    for g in {s for *_, s in texts if s is not None}:
        mine = [(d, w) for d, w, s in texts if s == g and w]
        if not mine:
            continue
        avg = sum(len(w) for _, w in mine) / len(mine)
        for q, text in queries:
            found = []
            for d, w in mine:
                score = 0.0
                for t in text.split():
                    df = sum(t in x for _, x in mine)
                    tf = w.count(t)
                    score += math.log(1 + (len(mine) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / avg))
                if score:
                    found.append((-round(score, 6), d))
            out += [(q, d, g, -s, i + 1) for i, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


QUERIES = [(1, "w0 w1 w55"), (2, "w0 w0 w2 w3 w59 w58"), (3, "nothing here"), (4, "w0"), (5, "w50 w50 w1 w2 w3 w4 w5 w6")]


@pytest.mark.parametrize("parts,k", [(1, 3), (5, 3), (3, 500)])
def test_equal_to_loops_over_all_documents(spark, parts, k):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts, "doc_id")
    q = spark.createDataFrame(QUERIES, "query long, text string")
    got = sorted(((r.query, r.doc, 0, r.score, r.rank) for r in retrieve.bm25(docs, q, k).collect()), key=str)
    assert got == loops(rows, QUERIES, k)
    got = sorted(((r.query, r.doc, r.source, r.score, r.rank) for r in retrieve.bm25(docs, q, k, within="source").collect()), key=str)
    assert got == loops(rows, QUERIES, k, within=True)


def test_many_small_batches_skip_and_still_agree(spark):
    rows = corpus(600, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2)
    q = spark.createDataFrame(QUERIES, "query long, text string")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(((r.query, r.doc, 0, r.score, r.rank) for r in retrieve.bm25(docs, q, 4).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == loops(rows, QUERIES, 4)


def test_beyond_the_bound_joins_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    q = spark.createDataFrame(QUERIES, "query long, text string")
    fields = docs.where("source is not null").select(F.col("doc_id").alias("work"), F.explode(F.array(F.struct(F.lit("a").alias("field"), "text"), F.struct(F.lit("b").alias("field"), F.col("source").alias("text")), F.struct(F.lit("c").alias("field"), "text")))).select("work", "col.*")
    runs = []
    for most in (topk.MOST_TERMS, 2):
        monkeypatch.setattr(topk.asked, "__defaults__", (most,))
        runs.append([sorted(map(str, x.collect())) for x in (
            retrieve.bm25(docs, q, 6), retrieve.bm25(docs, q, 2, within="source").select("query", "doc", "source", "score", "rank"),
            retrieve.bm25f(fields, q, {"a": 3.0, "b": 1.0}, 5),
        )])
    assert runs[0] == runs[1]
    assert any("fields=['a']" in x for x in runs[0][2])


def test_only_the_best_of_each_partition_are_shuffled(spark):
    docs = spark.createDataFrame([(i, "the same words " + "x" * (i % 3)) for i in range(1000)], "doc_id long, text string").repartition(4)
    index = term_index(docs)
    q = spark.createDataFrame([(1, "the same words"), (2, "same")], "query long, text string")
    found = topk.top_documents(retrieve.one_field(index), retrieve.query_terms(q), 3, {"text": 1.0})
    parts = retrieve.one_field(index).rdd.getNumPartitions()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert sorted((r.query, r.doc, r.rank) for r in found.collect()) == sorted((x, d, i + 1) for x in (1, 2) for i, d in enumerate(first(docs, 3)))
    assert parts >= 1


def first(docs, k):
    """All have equal words but for the last, so shorter texts come first, then lesser ids."""
    rows = sorted((len(r.text.split()), r.doc_id) for r in docs.collect())
    return [d for _, d in rows[:k]]


def test_presence_rounds_half_up_and_names_may_be_strings(spark):
    docs = spark.createDataFrame([("b", "a b c"), ("a", "a"), (None, "a b"), ("c", "z"), ("d", "q1 " * 3)], "doc_id string, text string")
    q = spark.createDataFrame([("x", "a b"), ("y", " ".join(f"q{i}" for i in range(128)))], "query string, text string")
    found = topk.top_documents(retrieve.one_field(term_index(docs)), retrieve.query_terms(q), 3, {"text": 1.0}, presence=True)
    got = [(r.query, r.doc, r.score) for r in found.orderBy("query", "rank").collect()]
    assert got == [("x", None, 1.0), ("x", "b", 1.0), ("x", "a", 0.5), ("y", "d", 0.007813)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    q = spark.createDataFrame(QUERIES, "query long, text string")
    assert retrieve.bm25(docs, q).count() == 0
    assert retrieve.bm25(docs, q, within="source").count() == 0
    some = spark.createDataFrame(corpus(20), "doc_id long, text string, source string")
    assert retrieve.bm25(some, q.limit(0)).count() == 0
    assert retrieve.bm25(some, q, 0).count() == 0
