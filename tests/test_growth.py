"""Work that must not grow with the pairs of rows that share a value: what is shuffled is held against a bound."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orebody.functions import text as fn
from orebody.operators import cells, documents, evaluate, expand, index, memory, relations, retrieve, topk, visual


def shuffled(spark, make):
    """The rows of ``make()`` and the MB that were shuffled for them."""

    def written():
        nodes = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(nodes.apply(i).totalShuffleWrite() for i in range(nodes.size())) / 1e6

    before = written()
    rows = [tuple(r) for r in make().collect()]
    return rows, written() - before


@pytest.mark.parametrize("block", [1, 7, 2000])
def test_expanded_equals_a_join(spark, block):
    left = spark.range(200).select(F.col("id").alias("a"), F.when(F.col("id") % 9 < 8, F.col("id") % 9 % 4).alias("k"))
    right = spark.range(90).select(F.col("id").alias("b"), (F.col("id") % 5).alias("k")).unionByName(spark.sql("select 1L b, 1L k"))
    got = sorted(tuple(r) for r in expand.expanded(left, right, ["k"], block).select("k", "a", "b").collect())
    assert got == sorted(tuple(r) for r in left.join(right, "k").select("k", "a", "b").collect())
    assert expand.expanded(left.limit(0), right, ["k"]).count() == 0


def test_questions_are_parsed_in_tasks_of_bounded_rows(spark, monkeypatch):
    """Values are read once, and rows are dealt by their number however few files hold them."""
    monkeypatch.setattr(expand, "DEALT", 20)
    names = ["Ann Lee", "lee ann", "unknown", "A (1801-1850)", "7", None, "é ü"]
    dates = ["1800", "c. 1801 - 1802", "1802-1801", "0000", "x", "", "约1700年"]
    rows = [(i, f"Maker: {names[i % 7]}\nDate: {dates[i % 7]}" if names[i % 7] else None) for i in range(140)]
    works = spark.createDataFrame(rows, "work long, content string").coalesce(1)
    made = index.label_index(works, {"author": ("Maker",), "date": ("Date",)}, "unknown")
    found = {(r.kind, r.key): 0 for r in made.collect()}
    assert found.keys() == {("author", "ann lee"), ("author", "a"), ("author", "é ü"), ("date", "false|1800|"), ("date", "true|1801|1802"), ("date", "true|1700|")}
    assert "RoundRobinPartitioning(32)" in made._jdf.queryExecution().toString()
    asked = [(1, "Find works dated ca. 1801-1802"), (2, "find works by  Lee, Ann."), (3, "find works by unknown"), (4, "Find objects dated 1802-1801"), (5, None), (6, "1800"), (None, "Find works dated 1800")]
    got = relations.metadata_lookup(spark.createDataFrame(asked, "query long, text string"), made, "unknown").collect()
    want = [(1, "date", "true|1801|1802", i) for i in range(1, 140, 7)] + [(2, "author", "ann lee", i) for i in range(140) if i % 7 < 2] + [(None, "date", "false|1800|", i) for i in range(0, 140, 7)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_references_of_equal_titles(spark):
    c = spark.range(400).select(F.col("id").alias("doc"), F.lit("see <red ring> and see <red ring> see <hot>").alias("text"))
    t = spark.range(400).select(F.col("id").alias("doc"), F.lit("red ring two").alias("title"))
    t = t.unionByName(spark.sql("select 7L doc, 'ring, red hot' title union all select 500L, '' union all select 7L, 'red ring two'"))
    got, mb = shuffled(spark, lambda: documents.references(c, t, ("see <([^>]{2,40})>",)).select("src", "dst", "n_matches"))
    assert sorted(got) == [(a, b, 3 if b == 7 else 2) for a in range(400) for b in range(400) if a != b]
    assert mb < 0.5


def test_merge_proposals_of_equal_patterns(spark):
    sets = [["p", "q", "r"], ["q", "p", "r", "p"], ["p", "q"], ["a", "b", "c", "d", "e", "q"], ["a", "b", "c", "d", "e"], [None, "q", "z"], [], None]
    rows = [(i, sets[i % 8], None if i % 11 == 0 else i % 2 // 1) for i in range(400)]
    s = spark.createDataFrame(rows, "skill long, patterns array<string>, action int")
    done = spark.createDataFrame([(i, i + 16) for i in range(400)] + [(1, None)], "a long, b long")
    want = set()
    for (a, x, m), (b, y, n) in itertools.combinations(rows, 2):
        if x and y and m is not None and m == n and b != a + 16:
            both = len((set(x) & set(y)) - {None})
            j = round(both / (len(set(x)) + len(set(y)) - both), 6)
            if both and j > 0.4:
                want.add((a, b, j))
    got, mb = shuffled(spark, lambda: documents.merge_proposals(s, done, 0.4))
    assert len(got) == len(want) and {(a, b, round(j, 6)) for a, b, j in got} == want
    assert {r[2] for r in documents.merge_proposals(s, done).collect()} == {x[2] for x in want if x[2] > 0.8}
    assert mb < 0.5


def test_number_clues_take_the_first_works(spark):
    photos = spark.range(300).select(F.col("id").alias("photo"), F.lit("K1").alias("key")).unionByName(spark.sql("select 3L photo, 'K2' key"))
    index = spark.sql("select 'K1' key, sequence(10L, 4000L) works union all select 'K2', array(1L, 11L, 12L)")
    decided = spark.range(300).select(F.col("id").alias("photo"), F.when(F.col("id") == 9, "likely_match").otherwise("uncertain").alias("state"), F.expr("if(id % 2 = 0, array(10L, 12L), array(77777L))").alias("selected"))
    got, mb = shuffled(spark, lambda: visual.number_clues(photos, index, decided))
    first = lambda i: (1, 10) if i == 3 else (11, 13) if i % 2 == 0 else (10, 11)
    assert sorted(got) == sorted((i, w, k) for i in range(300) if i != 9 for k, w in enumerate(first(i), 1))
    assert mb < 1


def test_comparison_views_meet_the_first_of_each_kind(spark):
    rows = [(v, v % 3, [None, "whole", "detail", "whole"][v % 4]) for v in range(900)] + [(5, 2, "whole")]
    views = spark.createDataFrame(rows, "view long, work long, kind string")
    hits = [(q, v % 3, v, 1 + q % 6) for q in range(150) for v in (q, q + 3)] + [(900, 1, 0, 1)]
    h = spark.createDataFrame(hits, "query long, work long, view long, rank int")
    want = []
    for images in (1, 2, 5):
        got, mb = shuffled(spark, lambda n=images: visual.comparison_views(h, views, images=n))
        groups = {}
        for q, w, g, r in hits:
            if r <= 5:
                for _, _, gk in [x for x in rows if x[0] == g]:
                    for v, vw, k in rows:
                        if vw == w:
                            other = None if k is None or gk is None else k != gk
                            groups.setdefault((q, w), []).append((v != g, {True: 0, False: 1, None: 2}[other], v))
        want = [(q, w, x[2], i) for (q, w), c in groups.items() for i, x in enumerate(sorted(c)[:images], 1)]
        assert sorted(got) == sorted(want)
        assert mb < 0.5


def test_words_end_beside_other_letters(spark):
    texts = ["é de", "éde", "deé", "de_", "DE", "node", "niçdeé", "perſuſ", "x2de"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = [r.i for r in df.where(F.col("x").rlike(fn.any_word("find|de"))).collect()]
    assert sorted(got) == [0, 1, 2, 4, 6]
    assert df.where(F.col("x").rlike(fn.any_word("persus"))).count() == 0
    assert df.where(F.concat("x", F.lit("a")).rlike(fn.any_word("persusa"))).count() == 1


def test_lookups_of_common_keys(spark):
    index = spark.range(2000).select(F.when(F.col("id") % 2 == 0, "A1").otherwise("B2").alias("key"), F.col("id").alias("work"))
    held = index.groupBy("key").agg(F.array_sort(F.collect_set("work")).alias("works")).unionByName(spark.sql("select 'C3' key, array(0L, 5000L) works"))
    photos = spark.createDataFrame([(i, "No: a-1\nx\nA1") for i in range(100)] + [(100, "a1\nc3"), (101, None), (102, "d4")], "query long, text string")
    semantic = spark.sql("select 7L query, 1L work")
    got, mb = shuffled(spark, lambda: relations.line_lookup(photos, held, semantic, "(?i)^no:"))
    evens = range(0, 2000, 2)
    want = [(q, w, "identifier", 0) for q in range(101) for w in evens] + [(100, 5000, "identifier", 0), (7, 1, "semantic", 1)]
    assert sorted(got) == sorted(want)
    assert mb < 0.5
    q = spark.createDataFrame([(i, "find works by Ann Lee.") for i in range(100)] + [(500, "Find works dated c. 1800")], "query long, text string")
    labels = index.select(F.lit("author").alias("kind"), F.when(F.col("key") == "A1", "ann lee").alias("key"), "work").unionByName(spark.sql("select 'date' kind, 'true|1800|' key, 3L work"))
    found = relations.metadata_lookup(q, labels, "unknown").collect()
    assert sorted(map(tuple, found)) == sorted([(i, "author", "ann lee", w) for i in range(100) for w in evens] + [(500, "date", "true|1800|", 3)])


@pytest.mark.parametrize("pivots", [1, 9])
def test_near_exact_loses_no_pair(spark, monkeypatch, pivots):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 8))[rng.integers(0, 12, 300)] + rng.normal(size=(300, 8)) * rng.choice([0, 0.3], (300, 1))
    rows = [(7 * i % 300, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [2.0]), (903, [float("nan")] * 8)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    names = [r[0] for r in rows[:300]]
    want = sorted([tuple(sorted((names[i], names[j]))) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.9 - 1e-12, 1)), strict=True)] + [(901, 902)])
    monkeypatch.setattr(cells, "BLOCK", -(-304 // pivots))
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    assert sorted(map(tuple, documents.near_exact(v, 0.1).collect())) == want
    edges = spark.createDataFrame(want, "a long, b long")
    forest = documents.near_exact(v, 0.1, forest=True)
    assert sorted(documents.clusters(forest).collect()) == sorted(documents.clusters(edges).collect())
    assert forest.count() < len(want) / 2
    assert cells.within(v.limit(0), 0.5).count() == 0


def test_clusters_make_their_pairs_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    pairs = spark.range(400).selectExpr("id div 10 * 10 a", "if(id % 10 = 0, null, id) b").mapInArrow(count, "a long, b long")
    got = {r.node: r.cluster for r in documents.clusters(pairs.where("b is not null")).collect()}
    assert got == {i: i // 10 * 10 for i in range(400)} and made.value == 400


def test_pieces_of_a_batch_are_bounded():
    words = [[{"field": "text", "words": ["w"] * n}, {"field": "x", "words": None}] for n in (3, 0, 9, 1, 1, 2)]
    batch = pa.record_batch([pa.array(range(7)), pa.array([*words, None])], names=["doc", "fields"])
    got = list(topk._pieces(iter([batch, batch.slice(2, 0), batch.slice(3, 2)]), 4))
    assert [p.column(0).to_pylist() for p in got] == [[0, 1], [2], [3, 4, 5, 6], [3, 4]]
    assert [len(topk._segments(p, ["text"])[3]) for p in got] == [3, 9, 4, 2]


def test_equal_queries_are_asked_once(spark, monkeypatch):
    fields = spark.createDataFrame([(1, "name", "red ring"), (2, "name", "blue ring"), (3, "name", "x")], "work long, field string, text string")
    q = spark.createDataFrame([(i, "red ring" if i % 2 else "blue") for i in range(50)] + [(50, None), (51, "")], "query long, text string")
    seen, real = [], retrieve.top_documents
    monkeypatch.setattr(retrieve, "top_documents", lambda index, terms, *a, **k: seen.append(terms.select("query").distinct().count()) or real(index, terms, *a, **k))
    got = retrieve.bm25f(fields, q, {"name": 2.0}, 2).select("query", "doc", "fields", "rank").collect()
    want = [x for i in range(50) for x in ([(i, 1, ["name"], 1), (i, 2, ["name"], 2)] if i % 2 else [(i, 2, ["name"], 1)])]
    assert sorted(map(tuple, got)) == want and seen == [2]


def _same_in_more_tasks(monkeypatch, make, least):
    rows, one = sorted(map(str, make().collect())), make().rdd.getNumPartitions()
    monkeypatch.setattr(expand, "DEALT", 20, raising=False)
    assert sorted(map(str, make().collect())) == rows
    assert make().rdd.getNumPartitions() >= least > one


def test_sources_are_checked_in_tasks_of_bounded_rows(spark, monkeypatch):
    facts = spark.range(400).selectExpr("id % 90 fact", "if(id % 7 = 0, null, id % 60) chunk", "'d' || id % 2 dept", "if(id % 3 = 0, null, '1') version")
    facts = facts.withColumn("chunk", F.col("chunk").cast("long"))
    chunks = spark.range(50).selectExpr("id chunk", "if(id % 9 = 0, null, id % 20) doc")
    docs = spark.range(18).selectExpr("id doc", "'d' || id % 2 dept", "'1' version", "if(id % 5 = 0, 'archived', 'active') status")
    _same_in_more_tasks(monkeypatch, lambda: memory.valid_sources(facts, docs, chunks), 20)
    have, doc = {r.chunk: r.doc for r in chunks.collect()}, {r.doc: r for r in docs.collect()}
    want = {}
    for r in facts.collect():
        d = doc.get(have.get(r.chunk))
        n, ok = want.get(r.fact, (0, 0))
        want[r.fact] = (n + 1, ok + bool(d and d.status == "active" and d.dept == r.dept and r.version in (None, d.version)))
    assert {r.fact: (r.n_sources, r.n_valid) for r in memory.valid_sources(facts, docs, chunks).collect()} == want


def test_stage_ranks_in_tasks_of_bounded_rows(spark, monkeypatch):
    ranked = spark.range(400).selectExpr("id % 40 case", "id % 33 doc", "id div 40 + 1 rank")
    gold = ranked.where("doc % 5 = 0").select("case", "doc").distinct()
    _same_in_more_tasks(monkeypatch, lambda: evaluate.stage_ranks(ranked, gold), 20)


def test_aliases_in_tasks_of_bounded_rows(spark, monkeypatch):
    c = spark.range(400).selectExpr("id % 40 request", "id candidate")
    _same_in_more_tasks(monkeypatch, lambda: visual.aliased(c), 20)
    named = visual.aliased(c)
    assert visual.restored(named.select("request", "alias"), named)[0].count() == 400


def test_keywords_without_a_shuffle_of_postings(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.2, 400) % 3000)) for i in range(400)] + [(400, ""), (401, None), (402, "w1 w1 zz")]
    terms = index.term_index(spark.createDataFrame(rows, "doc_id long, text string"))
    want, old = shuffled(spark, lambda: index.keywords(index.index_postings(terms), index.index_collection(terms)))
    got, mb = shuffled(spark, lambda: index.index_keywords(terms))
    assert sorted(got) == sorted(want) == sorted(map(tuple, index.index_keywords(terms, most=5).collect()))
    assert len(got) > 2000 and mb < old / 4


def test_org_recall_hands_on_no_row_for_each_fact_of_a_common_word(spark):
    kinds = ("official", "inferred", "rumour", None)
    facts = [(i, kinds[i % 4], f"the w{i % 50} w{i % 7} The") for i in range(3000)] + [(9000, "official", None), (9001, "official", "")]
    asked = [(j, f"the w{j} w{j % 7} zz") for j in range(60)] + [(100, ""), (101, None)]
    weights = {"official": 1.0, "inferred": 0.4, "rumour": 0.0}
    want = []
    for j, q in asked:
        mine = set((q or "").split())
        found = [(-round(len(mine & set((t or "").lower().split())) / len(mine) * weights.get(a, 0), 6), i) for i, a, t in facts] if mine else []
        want += [(j, i, -s, r) for r, (s, i) in enumerate(sorted(x for x in found if x[0] < 0)[:8], 1)]
    f, q = spark.createDataFrame(facts, "fact long, authority string, text string").cache(), spark.createDataFrame(asked, "query long, text string").cache()
    got, mb = shuffled(spark, lambda: memory.org_recall(f, q, weights))
    assert sorted(got) == sorted(want) and mb < 0.3
    tiny = {"official": 1e-7, "inferred": 1.0}
    assert {r.fact % 4 for r in memory.org_recall(f, q, tiny).collect()} == {1}


def test_backtest_deals_traces_into_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(expand, "DEALT", 50)
    skills = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y", None]), ("none", ["zzz"]), ("empty", [])], "skill string, patterns array<string>")
    rows = [(i % 900, "xy"[i % 2] + ("y" if i % 3 == 0 else ""), i % 5 == 0) for i in range(1000)] + [(5000, None, True)]
    traces = spark.createDataFrame(rows, "trace long, text string, ok boolean")
    hits = {}
    for skill, phrases in (("a", "xy"), ("b", "y")):
        for trace, text, ok in rows:
            if any(p in (text or "") for p in phrases):
                hits.setdefault(skill, {})[trace] = hits.get(skill, {}).get(trace, False) or ok
    want = {s: (len(h), round(sum(h.values()) / len(h), 6)) for s, h in hits.items()} | {"none": (0, 0.0), "empty": (0, 0.0)}
    found = documents.backtest(skills, traces)
    assert {r.skill: (r.n, r.success) for r in found.collect()} == want
    assert "hashpartitioning(trace" in (plan := found._jdf.queryExecution().toString()) and "hashpartitioning(skill#" in plan and ", trace#" not in "".join(x for x in plan.split("\n") if "hashpartitioning(skill" in x)
