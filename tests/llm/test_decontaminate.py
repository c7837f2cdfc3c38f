import random
import re

import pytest

from orebody.llm import decontaminate as dec


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(13, len(v))
            for a in range(len(v) - n + 1) if v else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        found |= {str(item)} if item is not None else set()
        out.append((doc, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


RNG = random.Random(2)
LEX = [f"w{i}" for i in range(40)] + ["the"] * 30 + ["of"] * 20


def prose(n):
    return " ".join(RNG.choice(LEX) for _ in range(n))


ITEMS = [(i, prose(RNG.choice([14, 20, 36]))) for i in range(8)]
ITEMS += [(20, ITEMS[0][1].upper()), (21, "the of"), (22, ""), (23, None), (24, "Étude w1 É"), (25, "unheard word"), (None, ITEMS[1][1] + " tail"), (26, "the"), (3, ITEMS[3][1])]
DOCS = [(i, prose(60)) for i in range(20)]
DOCS += [(100, prose(5) + " " + ITEMS[0][1] + ". " + prose(3)), (101, prose(400) + "\n" + ITEMS[1][1].replace(" ", ", ")), (102, " ".join(words(ITEMS[2][1])[:13])),
         (103, " ".join(words(ITEMS[2][1])[:12])), (104, ITEMS[4][1] + " " + ITEMS[4][1]), (104, ITEMS[5][1]), (None, ITEMS[5][1]), (105, None), (106, ""), (107, "étude w1 é"),
         (108, "the " * 300), (100, prose(5) + " " + ITEMS[0][1]), (109, " ".join(t for _, t in ITEMS[:8]))]
ITEMS += [(30, "the " * 20)]


@pytest.mark.parametrize("most", [dec.MOST_TERMS, 0])
def test_contamination_equals_brute_force(spark, most):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = dec.contamination(docs, bench, most=most).select("id", "n_words", "n_hit", "items", "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(DOCS, ITEMS), key=str)


def test_drop_contaminated(spark):
    docs = spark.createDataFrame([(*r, "x") for r in DOCS], "doc_id long, text string, key string")
    bench = spark.createDataFrame(ITEMS[:8], "item_id long, text string")
    kept = dec.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    want = [d for d, b in zip(DOCS, brute(DOCS, ITEMS[:8]), strict=True) if not b[4]]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS[:3], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dec.contamination(docs.limit(0), bench).count() == 0
    assert [r.n_hit for r in dec.contamination(docs, bench.limit(0)).collect()] == [0, 0, 0]


def test_proximity_finds_words_moved_apart(spark):
    item = "zero one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, item), (2, item.replace("six", "six and a half")), (3, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    index, _, texts, picked = dec.build(docs, bench, 13, "doc_id", "text", "item_id", "text")
    exact = {bytes(r.key) for r in dec.phrase_matches(index, texts, picked).collect()}
    assert exact == {dec._key(item.encode())}
    first = spark.createDataFrame([(b"b", 0, "zero", 1), (b"b", 12, "twelve", 2)], "bench binary, at int, term string, rank int")
    own = dec.postings(docs, first.select("term"), "text")
    near = dec.proximity_matches(own, first, slop=3).collect()
    assert [(bytes(r.key), r.begin, r.off) for r in near] == [(dec._key(item.replace("six", "six and a half").encode()), 0, 3)]
    assert dec.proximity_matches(own, first, slop=2).count() == 0


def test_repeated_words_are_searched_once(spark):
    """One item and one document of m equal words: postings meet picked words m times, not m squared."""
    for m in (100, 400):
        docs = spark.createDataFrame([(1, "ha " * m), (2, "so " + "ha ho " * m), (3, "ha " * 12)], "doc_id long, text string")
        rows = [(1, "ha " * m), (2, "ha ho " * m + "he")]
        bench = spark.createDataFrame(rows, "item_id long, text string")
        index, _, _, picked = dec.build(docs, bench, 13, "doc_id", "text", "item_id", "text")
        assert index.join(picked, "term").count() <= 40 * m
        got = dec.contamination(docs, bench).select("id", "n_words", "n_hit", "items", "contaminated").collect()
        if m == 100:
            assert sorted(map(tuple, got)) == sorted(brute([(1, "ha " * m), (2, "so " + "ha ho " * m), (3, "ha " * 12)], rows))
