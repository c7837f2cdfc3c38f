import random
import re

import numpy as np
import pytest

from orebody.llm import cube_mix


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, list(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free = [s for s in free if s not in over]
    return target


def docs_of(n, rng, sources):
    return [(i, " ".join(["w"] * rng.choice([0, 1, 3, 10, 40, 300])), rng.choice(sources)) for i in range(n)]


def check(rows, out):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = brute_targets(sizes)
    assert len(out) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    for s in sizes:
        biggest = max(r.size for r in out if r.source == s)
        assert abs(taken[s] - want[s]) <= biggest, (s, taken[s], want[s])


@pytest.mark.parametrize("block", [4096, 16])
def test_mix_meets_targets(spark, block):
    rng = random.Random(3)
    rows = docs_of(900, rng, ["big"] * 8 + ["a", "b", "Z", "é", None]) + [(None, None, "a"), (5, "x y", "a"), (5, "x y", "a"), (7, "q " * 20000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    first = cube_mix.mix(df, block=block).collect()
    check(rows, first)
    again = cube_mix.mix(df.repartition(3), block=block).collect()
    key = lambda r: (r.id is None, r.id or 0, r.size, r.copies)
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, again), key=str)


def test_edges(spark):
    schema = "doc_id long, text string, source string, size int, target int"
    assert cube_mix.mix(spark.createDataFrame([], schema)).count() == 0
    empty = cube_mix.mix(spark.createDataFrame([(1, None, None, 1, 1), (2, "", "s", 1, 1)], schema)).collect()
    assert [r.taken for r in empty] == [0, 0] and all(r.target == 0 for r in empty)
    one = cube_mix.mix(spark.createDataFrame([(1, "a b c", "s", 1, 1)], schema)).first()
    assert (one.target, one.taken) == (4.5, 3) or one.taken == 6


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    p, size = rng.random(500), rng.integers(0, 1000, 500)
    out = cube_mix.flight(p, size, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())
    whole = cube_mix.land(out, size)
    assert set(whole) <= {0.0, 1.0}
    assert abs((whole * size).sum() - (p * size).sum()) <= size.max()


def test_flight_with_equal_sizes():
    rng = np.random.default_rng(1)
    out = cube_mix.flight(np.full(100, 0.3), np.full(100, 7), rng)
    assert ((out > 0) & (out < 1)).sum() <= 2 and out.sum() == pytest.approx(30)


def test_equal_rows_are_dealt_to_all_blocks(spark):
    """Rows without an id and of one size: no block holds them all."""
    rows = spark.createDataFrame([(None, "s", 7)] * 3000 + [(i, "s", 7) for i in range(100)], "id long, source string, size long")
    units = cube_mix._counted(rows, 50)
    assert units.count() == 3100 and units.where("id is not null and k > 0").count() == 0
    assert sorted(r.k for r in units.where("id is null").collect()) == list(range(3000))
    blocks = units.groupBy(cube_mix.F.pmod(cube_mix.F.xxhash64("id", "size", "k"), cube_mix.F.lit(62)).alias("b")).count()
    assert blocks.agg({"count": "max"}).first()[0] <= 100
