import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orebody.llm import periodic_runs as pr
from orebody.llm.periodic_runs import find_runs, kept_words, periodic_runs, strongest

FOLDER = "/root/testdata/sf0.001"


def brute(words, times=3, least=24):
    """Every stretch that no neighbour extends, for every period; kept where no smaller period fits."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, times * q) and not any(all(words[k] == words[k + p] for k in range(start, start + length - p)) for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def raw(s):
    return [c.encode() for c in s]


@pytest.mark.parametrize("text", [
    "", "a" * 23, "a" * 24, "a" * 500, "ab" * 12, "ab" * 11 + "a", "xab" + "ab" * 40 + "y" + "ab" * 15, "abcdefghi" * 3, "abcdefghi" * 2 + "abcdefgh",
    "z" + "abcdefghij" * 4 + "abc" + "abcdefghij" * 3, ("a" * 30 + "b") * 5, ("ab" * 20 + "c") * 4 + "ab" * 13, "aab" * 30 + "aa" * 20, "q".join("abc" * 9 for _ in range(6)),
])
def test_runs_equal_brute_force(text):
    assert find_runs(raw(text)) == brute(raw(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abc", min_size=1, max_size=14), st.integers(1, 9), st.text(alphabet="abcd", max_size=5)), max_size=6))
def test_random_repeats_equal_brute_force(parts):
    text = raw("".join(p * k + tail for p, k, tail in parts))
    assert find_runs(text) == brute(text)
    assert find_runs(text, 2, 8) == brute(text, 2, 8)


def test_fibonacci_words_and_large_sets(monkeypatch):
    a, b = "a", "ab"
    while len(b) < 600:
        a, b = b, b + a
    assert find_runs(raw(b)) == brute(raw(b)) != []
    monkeypatch.setattr(pr, "BLOCK", 4)
    for text in ("a" * 300, "ab" * 150 + "c" + "ab" * 60, "aab" * 80):
        assert find_runs(raw(text)) == brute(raw(text))


def test_equal_hashes_change_nothing(monkeypatch):
    rng = random.Random(5)
    text = raw("".join(rng.choice("ab") for _ in range(200)) + "abcde" * 9)
    monkeypatch.setattr(pr, "_repeats", lambda words, width: True)
    assert find_runs(raw("abcdefghijklmnopqrstuvwxyz")) == []
    assert find_runs(text) == brute(text)


def test_long_texts_are_quick():
    assert find_runs([b"a"] * 200_000) == [(0, 200_000, 1)]
    block = [b"%d" % i for i in range(20_000)]
    assert find_runs(block * 5 + block[:7]) == [(0, 100_007, 20_000)]
    assert find_runs([b"%d" % i for i in range(200_000)]) == []


def test_strongest_and_kept():
    assert strongest([(5, 30, 10), (0, 60, 20), (9, 30, 10)]) == (5, 30, 10)
    assert strongest([]) is None
    assert strongest([(0, 3 * 10**9 + 1, 10**9), (1, 3 * 10**9, 10**9)]) == (0, 3 * 10**9 + 1, 10**9)
    words = raw("xyababababz")
    assert kept_words(words, [(2, 8, 2)]) == raw("xyabz")
    assert kept_words(words, []) == words


def plant(words, doc):
    h = zlib.crc32(str(doc).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_table_nulls_ties_repeats_and_other_columns(spark):
    texts = [None, "", " \t\n", "one", "a " * 30, "x\ty\n" * 12 + "é", "a\xa0b " * 24, "a " * 30, "\x1cq " * 40]
    rows = [(None if i == 2 else i % 8, t, "n", 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, id int")
    got = sorted(str((r.id, r.n_words, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed)) for r in periodic_runs(docs).collect())
    want = []
    for i, t, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        runs = brute(w)
        want.append(str((i, len(w), runs, strongest(runs), b" ".join(kept_words(w, runs)).decode())))
    assert got == sorted(want)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_planted_tails(spark):
    texts = ["", " ", "solo", " ".join(f"w{i}" for i in range(300)), None]
    docs = spark.createDataFrame([(i, texts[i % 5]) for i in range(300)] + [(None, "a b")], "doc_id long, text string")
    for r in docs.withColumn("new", pr.planted(docs.text, docs.doc_id)).collect():
        want = r.text if r.text is None or r.doc_id is None else " ".join(plant(r.text.split(), r.doc_id))
        assert (r.new or "").split() == (want or "").split()


def test_query_equals_brute_force_on_whole_texts(spark):
    from orebody.llm.queries import QUERIES

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op12_periodic_runs"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    n = 0
    for r in rows:
        words = plant(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""), r.doc_id)
        if len(words) > 2500:
            continue
        runs = brute(words)
        n += bool(runs)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert (r.n_runs, (r.start, r.length, r.period, r.exponent_milli)) == (len(runs), want)
        assert r.runs_sha256 == sha("".join("%d,%d,%d\n" % x for x in runs))
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in dropped))
    assert n > 5
