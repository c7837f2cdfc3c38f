import math

import numpy as np
import pytest

from orebody.llm import embedding_dups as emb

SCHEMA = "vec_id long, embedding array<float>, label int, key int"


def brute(rows, least=0.95):
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) if g else None for (_, v), g in zip(rows, good, strict=True)]
    n = len(rows)
    near = [[j for j in range(n) if j != i and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(n)]
    label, out = list(range(n)), []
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(n)]
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        comp = min(ids, default=None) if good[i] else rows[i][0]
        out.append((rows[i][0], len(near[i]), comp, rows[i][0] is not None and rows[i][0] == comp))
    return out


def planted(rng, n=120, dim=24):
    rows = [(i, rng.normal(size=dim).tolist()) for i in range(n)]
    for c in range(4):
        base = rng.normal(size=dim)
        for _ in range(6 * 4**c if c < 2 else 5):
            rows.append((len(rows), (base + rng.normal(size=dim) * rng.choice([0.01, 0.05])).tolist()))
    rows += [(5000, rows[0][1]), (5001, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]), (6000, (np.array(rows[2][1]) * 7).tolist())]
    rows += [(7000, None), (7001, [0.0] * dim), (7002, [float("nan")] * dim), (7003, [float("inf")] + [1.0] * (dim - 1)), (7004, [None] + [1.0] * (dim - 1)), (7005, []), (7006, [1.0, 2.0]), (7007, [1.0, 2.0, 0.0]), (7008, [2.0, 4.0])]
    return rows


@pytest.mark.parametrize("block", [512, 5])
def test_groups_equal_brute_force(spark, block):
    rows = planted(np.random.default_rng(3))
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA)
    got = emb.embedding_groups(df, recall=0.9999, block=block).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_recall_at_the_threshold_and_precision(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= b @ a * a
        b /= np.linalg.norm(b)
        c = 0.9505 if i % 2 else 0.9495
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA)
    got = {r.id: r.n_links for r in emb.embedding_groups(df).collect()}
    assert all(got[2 * i] == 0 for i in range(0, 400, 2))
    assert np.mean([got[2 * i] for i in range(1, 400, 2)]) >= 0.9


def test_collision_chance_matches_draws():
    rng = np.random.default_rng(1)
    for distance in (0.3, 1.4):
        gaps = rng.normal(size=200_000) * distance
        assert np.mean(np.floor(rng.random(200_000) * 2 / 2 + gaps / 2) == 0) == pytest.approx(emb.collision(distance), abs=0.01)


def test_shape_grows_with_the_logarithm():
    k, tables = emb.shape(10**5)
    assert emb.shape(10**10)[0] <= 2 * k + 1 and tables < 60


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert emb.embedding_groups(df).count() == 0
