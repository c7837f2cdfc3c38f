import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from orebody.llm import vector_codes as vc
from orebody.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Plain loops over whole integers; ``rows`` are (id, vector, label)."""
    good = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    m = len(good[0][1]) // parts
    cut = lambda v, p: v[p * m : p * m + m]
    books = [[cut(v, p) for _, v, _ in good[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min((dist(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, v, _ in good:
                mine.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, xs in mine.items():
                books[p][e] = [sum(c) // len(c) for c in zip(*xs)]
    told = [(i, g, [near(cut(v, p), books[p]) for p in range(parts)]) for i, v, g in good]
    by = {}
    for _, g, found in told:
        by[g] = by.get(g, 0) + sum(d for d, _ in found)
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((str(i), "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), by[g], sha) for i, g, found in told)


def got(df, **kw):
    return sorted((str(r.id), r.code, r.error, r.group_error, r.codebooks_sha256) for r in vc.compress(df, **kw).collect())


def vector(rng, n=32):
    return [float(np.float32(rng.gauss(0, 0.4))) for _ in range(n)]


def test_ties_repeats_bad_vectors_and_null_groups(spark):
    rng = random.Random(1)
    rows = [(i, vector(rng), rng.choice([None, 1, 2])) for i in range(150)]
    rows += [(i, rows[7][1], None) for i in range(200, 260)] + [rows[3], rows[3], (None, vector(rng), 1), (7, vector(rng), 2)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.1] * 31 + [None], 1), (303, [float("nan")] + [0.0] * 31, 1), (304, [float("inf")] * 32, None)]
    rows += [(-5, [0.0, -0.0] * 16, 4)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", code string, position int").repartition(5)
    assert got(df) == brute(rows)
    assert got(df, entries=8, rounds=4) == brute(rows, entries=8, rounds=4)


def test_salts_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, vector(rng) if i % 3 else [0.25] * 32, 0) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(vc, "OWNED", 60)
    monkeypatch.setattr(vc, "SALTS", 1)
    assert got(df) == brute(rows)


def test_few_vectors_other_lengths_and_large_components(spark):
    rows = [(5, [1e30] + [0.5] * 15, 1), (6, [-1e30] + [0.25] * 15, 1), (9, [1.0] * 32, 1)]
    found = got(spark.createDataFrame(rows, SCHEMA))
    assert [(r[0], r[1], r[2]) for r in found] == [("5", "00" * 16, 0), ("6", "01" * 16, 0)]
    with pytest.raises(ValueError):
        vc.compress(spark.createDataFrame([(1, [1.0] * 17, 1)], SCHEMA))
    with pytest.raises(ValueError):
        vc.compress(spark.createDataFrame(rows, SCHEMA), entries=300)


def test_empty_tables(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(1, None, 1), (2, [float("nan")], 1)], SCHEMA)) == []


def test_only_movers_migrate(spark, monkeypatch):
    """Members that keep their entry stay in their partition; what a round shuffles are the others."""
    seen = []
    settled = vc._settled
    monkeypatch.setattr(vc, "_settled", lambda rdd: seen.append(rdd) or settled(rdd))
    rng = random.Random(4)
    got(spark.createDataFrame([(i, vector(rng), 0) for i in range(300)], SCHEMA))
    first, second = (r.mapPartitionsWithIndex(lambda i, it: [(i, k, len(b)) for k, b in it]).collect() for r in seen)
    n = seen[0].getNumPartitions()
    assert seen[1].getNumPartitions() == n  # a union that moved nothing, not one that put partitions side by side
    for rows in (first, second):
        assert all(i == vc._owner(k) % n for i, k, _ in rows)
        assert sum(m for *_, m in rows) == 300 * 16
    lineage = seen[1].toDebugString().decode()
    assert "PartitionerAwareUnionRDD" in lineage and "ShuffledRDD" in lineage


def test_query_equals_sql_and_brute_force(spark):
    rows = QUERIES["op13_vector_codes"](spark, FOLDER).collect()
    have = sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in rows)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{FOLDER}/embeddings.parquet'")
    want = con.execute(f"select vec_id, code, error, label_error, codebooks_sha256 from ({vc.ORACLE_SQL})").fetchall()
    assert have == sorted((str(r[0]), *r[1:]) for r in want)
    assert have == brute([(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()])
