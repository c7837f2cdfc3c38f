"""Closed forms, folds against plain Python, and frames with nulls, ties and repeats."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebody.functions import text as fn
from orebody.operators import chunks, documents, evaluate, evidence, retrieve, runlog
from orebody.sources import catalogue
from orebody.streaming import jobs


def test_bm25f_closed_form(spark):
    fields = spark.createDataFrame([(1, "title", "red vase"), (1, "body", ""), (2, "title", "blue cup"), (2, "body", "")], "work int, field string, text string")
    q = spark.createDataFrame([(1, "red")], "query int, text string")
    row = retrieve.bm25f(fields, q, {"title": 5.0, "body": 1.0}).first()
    assert row.doc == 1 and row.fields == ["title"]
    assert row.score == pytest.approx(math.log(2) * 5 * 2.5 / 6.5, abs=1e-6)
    with pytest.raises(ValueError):
        retrieve.bm25f(fields, q, {"title": 0.0})
    assert retrieve.bm25f(fields, q, {"title": 5.0}, k=0).count() == 0


def test_fusion_closed_form(spark):
    lanes = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "b", 1)], "query int, lane int, id string, rank int")
    got = retrieve.fuse(lanes).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a"]
    assert got[0].rrf == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)


def test_repeated_chunks_give_no_extra_vote(spark):
    rows = [(1, 0, "w", "c1", 1), (1, 0, "w", "c2", 2), (1, 0, "x", "c3", 3), (1, 1, "x", "c3", 1)]
    got = {r.work: r for r in retrieve.fuse_works(spark.createDataFrame(rows, "query int, lane int, work string, chunk string, rank int")).collect()}
    assert got["w"].rrf == pytest.approx(1 / 61, abs=1e-9) and got["w"].matches == 2 and got["w"].best == "c1"
    assert got["x"].rrf == pytest.approx(1 / 62 + 1 / 61, abs=1e-9) and got["x"].rank == 1


def split_of(text, least=300, most=600):
    if len(text) <= most:
        return [text]
    out, buf = [], ""
    for c in text:
        buf += c
        if c in "。！？；\n" and len(buf) >= least:
            out, buf = out + [buf], ""
    return [p[i : i + most] for p in out + ([buf] if buf else []) for i in range(0, len(p), most)]


def pack_of(pieces, least=300, most=600):
    out, buf, n = [], [], 0
    for p in pieces:
        if n + len(p) > most and n >= least:
            out, buf, n = out + ["\n".join(buf)], [], 0
        buf.append(p)
        n += len(p)
    merged = []
    for c in [x.strip() for x in out + (["\n".join(buf)] if buf else [])]:
        if not c:
            continue
        if merged and (len(c) < least or len(merged[-1]) < least):
            merged[-1] = (merged[-1] + "\n" + c).strip()
        else:
            merged.append(c)
    return merged


def test_chunk_folds_equal_plain_loops(spark):
    texts = ["", "short", "x" * 599, "x" * 1300, ("这是一句话。" * 30 + "y" * 50) * 9, "\n".join("word " * k for k in range(1, 160, 7)), "a。" * 2000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for r in df.select("text", chunks.hard_split(F.col("text")).alias("p")).collect():
        assert r.p == split_of(r.text)
    units = df.select("doc_id", F.split("text", "\n").alias("u"))
    got = units.select("u", chunks.merge_short(chunks.pack(F.flatten(F.transform("u", lambda u: chunks.hard_split(u))))).alias("c"))
    for r in got.collect():
        assert r.c == pack_of([p for u in r.u for p in split_of(u)])


def test_chunks_keep_the_text(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"line {i} " + "w" * (i % 90) for i in range(400))), (2, None), (3, "")], "doc_id int, text string")
    made = chunks.chunk_blocks(catalogue.text_blocks(docs)).orderBy("chunk").collect()
    want = "".join(docs.first().text.split())
    assert "".join("".join(r.content.split()) for r in made) == want
    assert [r.chunk for r in made] == list(range(len(made)))


def test_wrap_is_bounded_and_keeps_words(spark):
    line = " ".join("w" * (i % 40 + 1) for i in range(200)) + " " + "z" * 500
    out = spark.createDataFrame([(line,)], "x string").select(chunks.wrap(F.col("x")).alias("w")).first().w
    assert all(len(x) <= 220 for x in out) and "".join(out).replace(" ", "") == line.replace(" ", "")


def test_context_packing_skips_what_does_not_fit(spark):
    rows = [(1, 0, "aaaa"), (1, 1, "b" * 50), (1, 2, "cc"), (1, 3, "cc")]
    r = chunks.pack_context(spark.createDataFrame(rows, "request int, priority int, text string"), 10).first()
    assert (r.passage, r.included, r.omitted) == ("aaaa\ncc", [0, 2], [1])


def test_identifier_name_and_date_keys(spark):
    ids = {" ab–12.3/c ": "AB123C", "ＡＢ１２": "AB12", "no digits": None, "a?1": None, "": None, None: None, "x" * 101 + "1": None}
    df = spark.createDataFrame([(k,) for k in ids], "v string")
    assert {r.v: r.k for r in df.select("v", fn.identifier_key(F.col("v")).alias("k")).collect()} == ids
    names = {"Vincent van Gogh": ["gogh", "van", "vincent"], "Gogh, Vincent van": ["gogh", "van", "vincent"], "Claude Monet (French, 1840 - 1926)": ["claude", "monet"], "attributed to X": None, "Room 3": None}
    df = spark.createDataFrame([(k,) for k in names], "v string")
    assert {r.v: r.k for r in df.select("v", fn.name_key(F.col("v"), "attributed|after").alias("k")).collect()} == names
    dates = {"1889": (False, 1889, None), "c. 1800–1810年": (True, 1800, 1810), "1810-1800": None, "0000": None, "about 1800": None}
    df = spark.createDataFrame([(k,) for k in dates], "v string")
    assert {r.v: r.k and tuple(r.k) for r in df.select("v", fn.date_key(F.col("v")).alias("k")).collect()} == dates


def test_unknown_is_not_zero(spark):
    ranked = spark.createDataFrame([("a", 1, 10, 1), ("a", 2, 11, 1)], "arm string, case int, doc int, rank int")
    gold = spark.createDataFrame([(1, 10)], "case int, doc int")
    got = {r.case: r for r in evaluate.recall(evaluate.first_ranks(ranked, gold)).collect()}
    assert got[1].recall1 == 1.0 and got[1].rr == 1.0
    assert got[2].recall1 is None and got[2].rr is None


def test_spans_merge_over_white_space_only(spark):
    src = spark.createDataFrame([(1, "one two three four")], "source int, content string")
    q = spark.createDataFrame([(1, "one"), (1, "two"), (1, "four"), (1, "wo thr"), (1, "absent")], "source int, quote string")
    assert sorted((r.start, r.stop) for r in evidence.merged_spans(q, src).collect()) == [(0, 11), (14, 18)]


def test_near_pairs_and_clusters(spark):
    import random

    rng = random.Random(3)
    rows, base = [], []
    for c in range(5):
        v = [rng.gauss(0, 1) for _ in range(32)]
        for _ in range(6):
            w = [x + rng.gauss(0, 0.02) for x in v]
            n = math.sqrt(sum(x * x for x in w))
            rows.append((len(rows), [x / n for x in w]))
            base.append(c)
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    for block in (256, 4):
        pairs = documents.near_pairs(df, 0.05, recall=0.999, block=block)
        got = {r.node: r.cluster for r in documents.clusters(pairs).collect()}
        assert got == {i: 6 * c for i, c in enumerate(base)}
    assert documents.clusters(pairs.limit(0)).count() == 0


def test_contains_join_takes_long_and_short_phrases(spark):
    q = spark.createDataFrame([(1, "xx the quick\nbrown fox yy"), (2, "nothing"), (3, None)], "query int, text string")
    e = spark.createDataFrame([(1, "e quick\nbrown f"), (2, "no"), (3, "the slow brown fox"), (4, "")], "entry int, phrase string")
    assert sorted((r.query, r.entry) for r in retrieve.contains_join(q, e).collect()) == [(1, 1), (2, 2)]


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    rows = [(i % 7, i, i) for i in range(200)]
    df = spark.createDataFrame(rows, "session long, id long, t long").select("session", "id", F.timestamp_seconds("t").alias("ts"))
    df.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "m.parquet"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "m.parquet"))
    got = jobs.drained(jobs.numbered(stream)).collect()
    assert sorted((r.session, r.id, r.seq) for r in got) == sorted((s, i, i // 7 + 1) for s, i, _ in rows)


def test_nearest_vectors_by_both_ways(spark):
    rows = [(i, [math.cos(i * 0.1), math.sin(i * 0.1)]) for i in range(60)] + [(100, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    q = v.where("id in (0, 30)").select(F.col("id").alias("query"), "vec")
    want = []
    for query in (0, 30):
        s = sorted((-round(sum(a * b for a, b in zip(rows[query][1], x, strict=True)), 6), i) for i, x in rows)
        want += [(query, i, -d, k + 1) for k, (d, i) in enumerate(s[:4])]
    for most in (4096, 0):
        got = sorted(map(tuple, retrieve.cosine_top(v, q, 4, most).collect()))
        assert got == [pytest.approx(x) for x in sorted(want)]
    assert retrieve.cosine_top(v, q.limit(0), 4).count() == 0


@pytest.mark.parametrize("n", [1000, 1003])
def test_matrix_gaps_of_many_modes(spark, n):
    modes, cases = spark.range(n).select(F.col("id").alias("mode")), spark.range(2).select(F.col("id").alias("case"))
    runs = spark.range(n - 1).select(F.lit(0).cast("long").alias("case"), F.col("id").alias("mode"), F.lit(1).alias("repeat"))
    got = {tuple(r) for r in evaluate.matrix_gaps(runs, cases, modes, 1).collect()}
    assert got == {(1, m, 1) for m in range(n)} | {(0, n - 1, 1)}


def test_null_ragged_and_many_query_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []), (8, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    q = v.selectExpr("id query", "vec")
    want = {(a, b, round(sum(x * y for x, y in zip(va, vb)), 6)) for a, va in rows for b, vb in rows if {a, b} <= {1, 2, 8} or a == b == 4}
    for most in (1, 2, 4096):
        assert {(r.query, r.doc, r.score) for r in retrieve.cosine_top(v, q, 10, most).collect()} == want
    assert retrieve.cosine_top(v.limit(0), q, 3).count() == 0


def test_retakes_follow_the_whole_chain(spark):
    rows = [(0, None, "ok"), (1, 0, "ok"), (2, 1, "service"), (3, 2, "ok"), (4, 7777, "ok")] + [(i, i - 1, "service" if i % 3 else "ok") for i in range(5, 200)]
    got = {r.id: (r.retakes, r.allowed) for r in runlog.retakes(spark.createDataFrame(rows, "id long, parent long, status string")).collect()}
    status, parent = {i: s for i, _, s in rows}, {i: p for i, p, _ in rows}
    for i in status:
        n, at = 0, parent[i]
        while at in status:
            n, at = n + (status[at] != "service"), parent[at]
        assert got[i] == (n, n <= 1), i
    with pytest.raises(ValueError):
        runlog.retakes(spark.createDataFrame([(1, 2, "ok"), (2, 1, "ok")], "id long, parent long, status string"), max_rounds=5)


def test_near_pairs_reach_their_recall(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(300, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(300, 32))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.651 * a + np.sqrt(1 - 0.651**2) * b
    rows = [(i, x.tolist()) for i, x in enumerate(a)] + [(1000 + i, x.tolist()) for i, x in enumerate(near)] + [(9000, None)]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    every = np.vstack([a, near])
    names = [r[0] for r in rows[:-1]]
    want = {(names[i], names[j]) for i, j in zip(*np.nonzero(np.triu(every @ every.T >= 0.65, 1)), strict=True)}
    for block in (16, 256):
        got = {(r.a, r.b) for r in documents.near_pairs(v, 0.35, block=block).collect()}
        assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 300


def test_clean_up_deletes_what_was_stored(spark):
    from orebody import session

    folder = session.shared_dir(spark).removeprefix("file:")
    assert session.stored(spark.range(3), "x").count() == 3
    mine = [x for x in os.listdir(folder) if spark.sparkContext.applicationId in x]
    assert mine
    session.clean_up(spark)
    assert not [x for x in os.listdir(folder) if spark.sparkContext.applicationId in x]
    assert session.stored(spark.range(3), "x").count() == 3
