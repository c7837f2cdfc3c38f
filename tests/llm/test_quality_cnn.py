import random
import zlib

import numpy as np
import pytest

from orebody.llm import quality_cnn as cnn

RNG = random.Random(8)
SYLLABLES = ["an", "the", "ré", "ing", "or", "st", "ou", "ble", "ha", "ti"]


def word():
    return "".join(RNG.choice(SYLLABLES) for _ in range(RNG.choice([1, 2, 3])))


def clean():
    return " ".join(word() for _ in range(RNG.choice([3, 40, 200]))).capitalize() + "."


def junk():
    kind = RNG.randrange(3)
    if kind == 0:
        return clean() + "\n" + " ".join(f"{word().upper()}!!" for _ in range(60))
    if kind == 1:
        w = word()
        return clean() + " " + " ".join([w] * 40)
    return " ".join(f"{word()}{RNG.choice(['$$$', '***'])}" for _ in range(80))


@pytest.fixture(scope="module")
def rows():
    return [(i, junk() if i % 4 == 0 else clean(), 0 if i % 4 == 0 else 1) for i in range(600)]


def test_held_out_accuracy(spark, rows):
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows], "doc_id long, text string, y double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    net = cnn.fit(docs, labels, most=150)
    out = cnn.score(docs, net).withColumn("held_out", cnn.held_out()).collect()
    assert len(out) == len(rows) and out[0].y == 9.0
    held = [(r.score, rows[r.doc_id][2]) for r in out if r.held_out]
    assert {r.doc_id for r in out if r.held_out} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.95
    again = cnn.fit(docs, labels, most=150)
    assert all(np.array_equal(a, b) for a, b in zip(net.weights().values(), again.weights().values(), strict=True))


def test_training_sample_is_bounded_and_leaves_held_out_rows_alone(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(700, "x" * (cnn.MOST_BYTES + 1))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(1, 0), (700, 0)], "doc_id long, quality int")
    got = cnn.training_rows(docs, labels, "doc_id", "text", "quality", 30)
    assert (got["y"] == 0).sum() <= 30 and (got["y"] == 1).sum() <= 30 and len(got) > 50
    assert all(zlib.crc32(str(i).encode()) % 5 for i in got["__id"]) and not {1, 700} & set(got["__id"])


def test_blocks_do_not_change_a_score(monkeypatch):
    net = cnn.Network(3)
    texts = [("ab " * 40 + clean() * 30).encode()[: 200 + k] for k in range(0, 1200, 37)]
    whole = [net.score(t) for t in texts]
    monkeypatch.setattr(cnn, "BLOCK", 256)
    assert [net.score(t) for t in texts] == pytest.approx(whole, abs=1e-5)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 163, 164, 165, 168, 1000])
def test_score_equals_a_forward_pass_by_hand(n):
    net = cnn.Network(5)
    net.bias[:] = np.linspace(-0.5, 0.5, cnn.FILTERS)
    text = bytes(RNG.randrange(256) for _ in range(n))
    data = list(text)
    while len(data) < cnn.STRIDE * (cnn.SPAN - 1) + cnn.WIDTH or (len(data) - cnn.WIDTH) % cnn.STRIDE:
        data.append(0)
    fired = []
    for at in range(0, len(data) - cnn.WIDTH + 1, cnn.STRIDE):
        x = [net.embed[data[at + k]][e] for k in range(cnn.WIDTH) for e in range(cnn.EMBED)]
        fired.append([max(0.0, sum(float(a) * float(b) for a, b in zip(x, net.filters[:, f], strict=True)) + float(net.bias[f])) for f in range(cnn.FILTERS)])
    logit = float(net.shift[0])
    for f in range(cnn.FILTERS):
        logit += float(net.out[f]) * max(sum(r[f] for r in fired[at : at + cnn.SPAN]) / cnn.SPAN for at in range(len(fired) - cnn.SPAN + 1))
    assert net.score(text) == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-5)


def test_every_byte_has_an_embedding_of_its_own():
    assert cnn.Network().embed.shape == (256, cnn.EMBED)
    assert len(np.unique(cnn.Network().embed, axis=0)) == 256


def test_repeated_rows_teach_once_and_are_scored_each(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, quality int")
    got = cnn.training_rows(docs, labels, "doc_id", "text", "quality", 10)
    assert sorted(zip(got["__id"], got["text"], strict=True)) == [(1, "a"), (2, "")]
    out = cnn.score(docs, cnn.Network()).collect()
    assert sorted(r.text or "" for r in out) == ["", "a", "a", "b"]
    assert len({r.score for r in out if r.text == "a"}) == 1


def test_training_lowers_the_loss():
    texts, labels = [b"one two two two two two two two two two two", b"Nothing of note is here."], [0, 1]

    def loss(net):
        return -sum(np.log(net.score(t) if y else 1 - net.score(t)) for t, y in zip(texts, labels, strict=True)) / 2

    net = cnn.train(texts, labels, epochs=0)
    before = loss(net)
    after = loss(cnn.train(texts, labels, epochs=15))
    assert after < before / 2


def test_null_empty_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = cnn.score(docs, cnn.fit(docs, labels)).collect()
    assert all(r.score == 0.5 for r in out)
    assert cnn.score(docs.limit(0), cnn.Network()).count() == 0
