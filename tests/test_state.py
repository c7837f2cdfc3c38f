"""State, late rows, running totals and stored tables over several batches."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from orebody import session
from orebody.operators import memory, prefix, runlog
from orebody.sources.stored_table import StoredTable, TakenError, drain_into, write_report
from orebody.streaming import jobs

DAY = dt.datetime(2024, 5, 1)


def arrive(spark, rows, schema, path):
    """More files of a stream's source."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, schema, path):
    return spark.readStream.schema(schema).parquet(path)


def minute(m):
    return DAY + dt.timedelta(minutes=m)


def test_running_totals_of_a_hot_key(spark):
    rows = [(None if i % 7 == 0 else "hot" if i % 2 else f"k{i % 5}", i, i % 3 if i % 11 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(3)
    found = prefix.running(df, ["k"], ["at"], {"n": F.lit(1), "total": "v"})
    want, seen = {}, {}
    for k, at, v in rows:
        n, t = seen.get(k, (0, 0))
        seen[k] = want[k, at] = (n + 1, t + (v or 0))
    assert {(r.k, r.at): (r.n, r.total) for r in found.collect()} == want
    # The hot key lies in several ranges, so several tasks sum it up.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = df.repartitionByRange("k", "at").withColumn("p", F.spark_partition_id())
        assert ranges.where("k = 'hot'").select("p").distinct().count() > 1
        again = prefix.running(df, ["k"], ["at"], {"n": F.lit(1), "total": "v"})
        assert {(r.k, r.at): (r.n, r.total) for r in again.collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert prefix.running(df.limit(0), ["k"], ["at"], {"n": F.lit(1)}).count() == 0


def test_sequences_and_phases_of_one_key(spark):
    m = spark.createDataFrame([(1, minute(i // 3), i) for i in range(500)], "session long, ts timestamp, id long").repartition(4)
    assert {(r.id, r.seq) for r in memory.sequence_numbers(m).collect()} == {(i, i + 1) for i in range(500)}
    reviews = [("d", i, 1, int(i % 13 > 1)) for i in range(400)] + [("e", 0, 1, 1)]
    got = {(r.dept, r.at): (r.n, r.phase, r.changed) for r in runlog.phases(spark.createDataFrame(reviews, "dept string, at long, total int, correct int")).collect()}
    right, last = 0, "human_in_loop"
    for _, at, _, ok in reviews[:400]:
        right += ok
        good = round(right / (at + 1), 4) >= 0.8
        phase = "human_out_of_loop" if good and at + 1 >= 5 else "human_on_loop" if good else "human_in_loop"
        assert got["d", at] == (at + 1, phase, phase != last)
        last = phase


def test_a_row_leaves_by_its_timer_without_another_event(spark, tmp_path):
    schema = "session long, ts timestamp, expires_at timestamp"
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    write = lambda s, m, ttl=30: (s, minute(m), minute(m + ttl))

    def run():
        with jobs.rocks_state(spark):
            q = jobs.expired(stream(spark, schema, src), "1 minute").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
        return sorted((r.session, r.expires_at, r.writes) for r in spark.read.schema("session long, expires_at timestamp, writes long").parquet(out).collect())

    arrive(spark, [write(1, 0), write(2, 0), write(1, 10), write(1, 5)], schema, src)
    assert run() == []
    arrive(spark, [write(3, 35)], schema, src)  # session 2 has no event here; its time has passed
    assert run() == [(2, minute(30), 1)]
    arrive(spark, [write(2, 36), write(4, 100)], schema, src)  # session 2 begins anew; 1 and 3 expire by their timers
    assert run() == [(1, minute(40), 3), (2, minute(30), 1), (2, minute(66), 1), (3, minute(65), 1)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_counters_go_on_over_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "SNAPSHOT", 2)
    schema, src, root = "session long, id long, ts timestamp", str(tmp_path / "src"), str(tmp_path / "root")
    want, n = [], {}
    for b in range(6):
        rows = [(s, 100 * b + i, minute(i)) for i in range(30) for s in ([1, 1, 2, 3 + b][i % 4],)]
        arrive(spark, rows, schema, src)
        for s, i, _ in rows:
            n[s] = n.get(s, 0) + 1
            want.append((s, i, n[s]))
        got = [tuple(r) for r in jobs.numbered_on(stream(spark, schema, src), root).select("session", "id", "seq").collect()]
        assert sorted(got) == sorted(want)


def test_kept_and_late_rows_add_up(spark, tmp_path):
    schema, src, root = "ts timestamp, id long", str(tmp_path / "src"), str(tmp_path / "root")
    for rows in ([(minute(0), 1), (minute(100), 2)], [(minute(30), 3), (minute(50), 4), (None, 5)], [(minute(200), 6)], [(minute(150), 7), (minute(139), 8)]):
        arrive(spark, rows, schema, src)
        kept, late = jobs.kept_and_late(stream(spark, schema, src), F.col("ts"), root, "1 hour")
    assert sorted(r.id for r in late.collect()) == [3, 8]
    assert sorted(r.id for r in kept.collect()) == [1, 2, 4, 5, 6, 7]


SCHEMA = "id long, v string, at long"


def table(spark, path):
    return StoredTable(spark, str(path), SCHEMA, F.pmod(F.xxhash64("id"), F.lit(4)))


def test_upserts_touch_their_partitions_and_repeat_to_nothing(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.read().count() == 0
    t.append(spark.createDataFrame([(i, "a", 0) for i in range(40)], SCHEMA))
    before = t._manifest()[1]["parts"]
    new = spark.createDataFrame([(3, "b", 1), (3, "c", 2), (99, "d", 1)], SCHEMA)
    assert t.upsert(new, "id", "at", batch=7)
    want = {i: "a" for i in range(40)} | {3: "c", 99: "d"}
    assert {r.id: r.v for r in t.read().collect()} == want
    after = t._manifest()[1]["parts"]
    moved = {p for p in before if before[p] != after.get(p)}
    assert 1 <= len(moved) <= 2
    assert not t.upsert(spark.createDataFrame([(3, "z", 9)], SCHEMA), "id", "at", batch=7)
    assert {r.id: r.v for r in t.read().collect()} == want
    t.append(spark.createDataFrame([(500, "n", 0)], SCHEMA))
    t.compact()
    t.expire()
    assert {r.id: r.v for r in t.read().collect()} == want | {500: "n"}
    assert all(len(f) == 1 for f in t._manifest()[1]["parts"].values())


def test_readers_see_changes_whole_and_one_writer_wins(spark, tmp_path):
    t, other = table(spark, tmp_path / "t"), table(spark, tmp_path / "t")
    t.append(spark.createDataFrame([(1, "a", 0)], SCHEMA))
    reader = t.read()

    def slow(had):
        # While this change is being staged, another is made.
        other.append(spark.createDataFrame([(2, "b", 0)], SCHEMA))
        assert {r.id for r in t.read().collect()} == {1, 2}
        return had.withColumn("v", F.lit("x"))

    with pytest.raises(TakenError):
        t.change(slow)
    assert {(r.id, r.v) for r in t.read().collect()} == {(1, "a"), (2, "b")}
    assert [r.id for r in reader.collect()] == [1]


def test_a_failed_write_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.append(spark.createDataFrame([(1, "a", 0)], SCHEMA))
    with pytest.raises(Exception, match="boom"):
        t.change(lambda had: had.withColumn("v", F.raise_error(F.lit("boom")).cast("string")))
    assert [(r.id, r.v) for r in t.read().collect()] == [(1, "a")]


def test_a_stream_upserts_each_batch_once(spark, tmp_path):
    t, src = table(spark, tmp_path / "t"), str(tmp_path / "src")
    for b, check in enumerate(("c1", "c1", "c2")):  # the third checkpoint is new: all batches run again
        if b < 2:
            arrive(spark, [(i, f"b{b}", b) for i in range(b, 10)], SCHEMA, src)
        drain_into(stream(spark, SCHEMA, src), str(tmp_path / check), lambda batch, n: t.upsert(batch, "id", "at", n))
        n_versions = len(t._versions())
    assert n_versions == 2
    assert {r.id: r.v for r in t.read().collect()} == {0: "b0"} | {i: "b1" for i in range(1, 10)}


def test_reports_are_never_overwritten(spark, tmp_path):
    path = str(tmp_path / "report")
    write_report(spark.createDataFrame([(1,)], "x long"), path)
    with pytest.raises(TakenError):
        write_report(spark.createDataFrame([(2,)], "x long"), path)
    assert [r.x for r in spark.read.json(path).collect()] == [1]
    assert os.listdir(tmp_path) == ["report"]


def test_a_session_has_one_folder(spark):
    first = session.shared_dir(spark)
    session.stored(spark.range(2), "x")
    spark.range(2).checkpoint()
    assert session.shared_dir(spark) == first


def test_maintained_statistics_equal_those_from_scratch(spark, tmp_path, monkeypatch):
    import random

    from orebody.operators import maintained, retrieve

    monkeypatch.setattr(maintained, "COMPACT", 3)
    rng = random.Random(4)
    kept = maintained.TermStatistics(spark, str(tmp_path / "stats"))
    there = {}
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    q = spark.createDataFrame([(1, "w1 w2 w9"), (2, "w0 gone")], "query long, text string")
    for batch in range(5):
        new = [(100 * batch + i, " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(9))) or None) for i in range(15)]
        gone = [(d, there.pop(d)) for d in rng.sample(sorted(there), min(6, len(there)))] + ([(100, there.pop(100))] if 100 in there else [])
        there |= dict(new)
        assert kept.update(make(new), make(gone), batch)
        assert not kept.update(make(new), None, batch)
        docs = make(sorted(there.items()))
        df = {}
        for text in there.values():
            for w in set((text or "").split()):
                df[w] = df.get(w, 0) + 1
        assert {r.term: r.df for r in kept.frequency().collect()} == df
        got = retrieve.bm25(docs, q, 8, statistics=kept.now())
        assert sorted(map(str, got.collect())) == sorted(map(str, retrieve.bm25(docs, q, 8).collect()))
    assert kept.update() is False


def test_percentiles_of_one_hot_group_equal_those_of_all_values(spark):
    import math
    import random

    import numpy as np

    rng = random.Random(7)
    rows = [(None if i % 50 == 0 else "hot" if i % 10 else "cold", rng.choice([None, 1.5, float(rng.randrange(40)), rng.random()])) for i in range(3000)] + [("empty", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r for r in prefix.percentiles(df, ["g"], "v", {"d50": 0.5, "d95": 0.95}, {"c50": 0.5, "c95": 0.95}).collect()}
    held = {}
    for g, v in rows:
        held.setdefault(g, []).extend([] if v is None else [v])
    assert set(got) == {g for g, v in held.items() if v}
    for g, r in got.items():
        v = sorted(held[g])
        assert (r.d50, r.d95) == tuple(v[math.ceil(len(v) * p) - 1] for p in (0.5, 0.95))
        assert (r.c50, r.c95) == pytest.approx((np.percentile(v, 50), np.percentile(v, 95)))
    total = prefix.percentiles(df, [], "v", {"p": 0.5}).collect()
    every = sorted(x for v in held.values() for x in v)
    assert [r.p for r in total] == [every[math.ceil(len(every) * 0.5) - 1]]
    assert prefix.percentiles(df.limit(0), ["g"], "v", {"p": 0.5}).count() == 0


def test_keyed_digests_equal_the_standard_ones(spark):
    import hashlib
    import hmac

    from orebody.functions.text import hmac_sha256, squeeze

    df = spark.createDataFrame([("é1",), ("",), (None,)], "x string")
    for key in (b"k", b"long" * 40):
        got = [r.h for r in df.select(hmac_sha256(F.col("x"), key).alias("h")).collect()]
        assert got == [hmac.new(key, x.encode(), hashlib.sha256).hexdigest() for x in ("é1", "")] + [None]
    texts = ["　a \t b ", "  x\n\n\n\ny\x1f", "a b"]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "x string").select(squeeze(F.col("x")).alias("s")).collect()]
    assert got == ["a b", "x\n\ny", "a b"]


def test_covered_quotes_equal_a_look_at_every_character(spark):
    import random

    from orebody.operators import evidence

    rng = random.Random(12)
    quotes, spans, want = [], [], {}
    for i in range(300):
        quote = "".join(rng.choice("aab \n") for _ in range(rng.randrange(12)))
        mine = [quote[a : a + rng.randrange(1, 6)] for a in (rng.randrange(12) for _ in range(rng.randrange(5)))] + rng.choice([[], ["x" + quote + "y"], [""]])
        quotes.append((i, i, quote))
        spans += [(i, s) for s in mine]
        seen = set()
        for s in mine:
            for a in range(len(quote)):
                if s and quote.startswith(s, a):
                    seen |= set(range(a, a + len(s)))
        want[i] = bool(quote.strip(" ")) and (any(quote in s for s in mine) or all(c in " \n" or k in seen for k, c in enumerate(quote)))
    got = evidence.covered_quotes(spark.createDataFrame(quotes, "id long, source long, quote string"), spark.createDataFrame(spans, "source long, span string"))
    assert {r.id: r.covered for r in got.collect()} == want
    assert 20 < sum(want.values()) < 280


def test_quotes_meet_the_chunks_near_them(spark):
    import random

    from orebody.operators import relations

    rng = random.Random(5)
    stretch = lambda most: (a := rng.randrange(300), a + rng.randrange(most))
    quotes = [(rng.randrange(12), *stretch(60), rng.choice([1, 2, 5])) for _ in range(60)]
    chunks = [(rng.randrange(12), c, *stretch(90)) for c in range(80)]
    best = {}
    for w, a, b, weight in quotes:
        for v, c, x, y in chunks:
            shared = min(b, y) - max(a, x)
            if v == w and shared > 0:
                best[w] = min(best.get(w, (0, 0, 0)), (-shared * weight, c, shared)) if w in best else (-shared * weight, c, shared)
    q, c = spark.createDataFrame(quotes, "work long, start long, stop long, weight long"), spark.createDataFrame(chunks, "work long, chunk long, start long, stop long")
    for width in (7, 50, 1000):
        got = {r.work: (r.chunk, r.shared) for r in relations.bridge(q, c, width).collect()}
        assert {w: (b[1], b[2]) for w, b in best.items()}.keys() == got.keys()
        for w, (chunk, shared) in got.items():
            assert (chunk, -best[w][0]) == (best[w][1], -best[w][0])
