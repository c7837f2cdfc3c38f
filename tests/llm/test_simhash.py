import re
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from orebody.llm import simhash
from orebody.llm.components import connected_components


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            words, word = words + [word] if word else words, ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def brute_signature(text, seeds, shingle=3):
    """The fingerprint of each seed, by plain whole numbers."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return [0] * seeds
    hashes, out, top = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(len(words) - shingle + 1, 1))], [], 1 << 64
    for seed in range(seeds):
        now = []
        for h in hashes:
            if seed:
                h = h * (0x9E3779B97F4A7C15 * (2 * seed + 1)) % top
                h = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % top
                h ^= h >> 32
            now.append(h)
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in now) > len(now)))
    return out


def brute_shingles(text, n=5):
    """Sets of n successive words, A-Z lowered; fewer words are one shingle."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, min(len(words), 1)))}


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows, radius=2, near=None):
    """Components over all pairs; with ``near`` those that meet in a bucket and whose five-word Jaccard similarity is high enough."""
    every = [brute_signature(t, near.seeds, near.shingle) if near else [brute_fingerprint(t)] for _, t in rows]
    sets = [brute_shingles(t) for _, t in rows] if near else []
    fps = [x[0] for x in every]
    if near:
        # Whoever shares a bucket is checked, within the radius or not.
        masks = simhash.covering_masks(radius)
        meet = lambda x, y: any(not (a ^ b) & m for a, b in zip(x, y, strict=True) for m in masks)
        links = [(i, j) for i, j in combinations(range(len(rows)), 2) if meet(every[i], every[j]) and alike(sets[i], sets[j]) >= 0.8]
    else:
        links = [(i, j) for i, j in combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= radius]
    label = components(range(len(rows)), links)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc, fps[i], min(ids, default=None)))
    return out


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if "near" in more:
        return [(r.id, r.key, r.component) for r in simhash.near_groups(docs, **more).collect()]
    found = simhash.simhash_groups(docs, **more).collect()
    return [(r.id, r.fp % (1 << 64), r.component) for r in found]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_masks_cover_every_pair_within_the_radius():
    for radius in (2, 4):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for bits in combinations(range(64), 2):
            assert any(not m & sum(1 << b for b in bits) for m in masks)
    masks = simhash.covering_masks(2)
    assert not any(all(not m & (1 << b) for b in (0, 1, 3)) for m in masks)


def test_fingerprint_equals_brute_force():
    texts = ["", " \t\n", "One", "two Words", "a b c", "a a a a a", "Ünï ÄÖ\x0bx\x0cy z q", "x " * 5000, None]
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) == brute_fingerprint(t)


def test_signatures_equal_brute_force():
    for t in ("", "One", "two Words", "a b c d e f g", "Ünï ÄÖ\x0bx\x0cy z q", "x y " * 500, None):
        assert list(map(int, simhash.signature((t or "").encode(), 3, 7))) == brute_signature(t, 7)
        assert brute_signature(t, 1) == [brute_fingerprint(t)]


def test_near_links_more_near_copies(spark):
    import random

    rng = random.Random(2)
    lex = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(60):
        words = [rng.choice(lex) for _ in range(200)]
        rows.append((2 * i, " ".join(words)))
        for _ in range(3):
            words[rng.randrange(200)] = "new"
        rows.append((2 * i + 1, " ".join(words)))
    near = simhash.Near()
    one, many = run(spark, rows), run(spark, rows, near=near)
    assert order(one) == order(brute(rows))
    assert {i: c for i, _, c in many} == {i: c for i, _, c in brute(rows, near=near)}
    removed = lambda found: sum(i != c for i, _, c in found)
    assert removed(many) >= 30 and removed(many) > 2 * removed(one) and all(c in (i, i - 1) for i, _, c in many)


def jaccard(x, y):
    x, y = (set(zip(*(t.split()[k:] for k in range(5)))) for t in (x, y))
    return len(x & y) / len(x | y)


def test_near_links_are_those_of_the_similarity(spark):
    import random

    rng = random.Random(6)
    lex = [f"w{i}" for i in range(2000)]
    rows, alike = [], {}
    for i in range(80):
        words = [rng.choice(lex) for _ in range(300)]
        rows.append((2 * i, " ".join(words)))
        for _ in range(rng.choice([1, 3, 5, 12, 20, 40])):
            words[rng.randrange(300)] = "new"
        rows.append((2 * i + 1, " ".join(words)))
        alike[2 * i + 1] = jaccard(rows[-2][1], rows[-1][1])
    # The same words in another order are no copy.
    mixed = rows[0][1].split()
    rng.shuffle(mixed)
    rows.append((500, " ".join(mixed)))
    got = {i: c for i, _, c in run(spark, rows, near=simhash.Near())}
    assert got[500] == 500
    close = [got[i] == i - 1 for i, j in alike.items() if j >= 0.85]
    assert sum(close) >= 0.7 * len(close) > 20
    assert all(got[i] == i for i, j in alike.items() if j < 0.8)


def test_nothing_below_the_similarity_is_removed(spark):
    """Against all pairs by Jaccard: groups are parts of the true ones, and near copies are found."""
    import random

    rng = random.Random(8)
    common = ["the", "of", "and", "to", "a", "in"] * 40
    lex = common + [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        words = [rng.choice(lex) for _ in range(120)]
        for k in range(rng.choice([1, 2, 5, 9])):
            now = list(words)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
                now[rng.randrange(120)] = "new"
            rows.append((100 * i + k, " ".join(now)))
    rows += [(9000, ""), (9001, None), (9002, " "), (9003, "one two"), (9004, "One  two"), (9005, "one two three")]
    sets = [brute_shingles(t) for _, t in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if alike(sets[i], sets[j]) >= 0.8]
    label = components(range(len(rows)), links)
    true = {rows[i][0]: rows[label[i]][0] for i in range(len(rows))}
    got = {i: c for i, _, c in run(spark, rows, near=simhash.Near())}
    assert all(true[i] == true[c] for i, c in got.items())
    gone = [i for i, c in true.items() if i != c]
    assert sum(got[i] != i for i in gone) >= 0.95 * len(gone) > 30
    assert {i: got[i] for i in range(9000, 9006)} == {9000: 9000, 9001: 9000, 9002: 9000, 9003: 9003, 9004: 9003, 9005: 9005}


def test_near_loses_no_link(spark):
    """Groups equal those of all pairs by Jaccard, also of texts that share no bucket or that only others of their bucket would show."""
    import random

    rng = random.Random(12)
    rows, line = [], "all rights are reserved by the owner of this page and its friends"
    for i in range(60):
        words = [f"w{rng.randrange(100_000)}" for _ in range(60)]
        for k in range(4):
            now = list(words)
            for _ in range(rng.choice([0, 1, 2, 3])):
                now[rng.randrange(60)] = rng.choice(["new", f"w{rng.randrange(100_000)}"])
            rows.append((10 * i + k, " ".join(now) + (f" {line}" if i % 2 else "")))
    # The same sets of shingles, very different numbers of each.
    long, short = "one two three four five six seven eight nine ten eleven twelve", "a b c d e f"
    rows += [(5000, f"{long} {short} " + f"{short} " * 40), (5001, f"{long} {short} " + f"{long} " * 20), (5002, line), (5003, f"{line} now")]
    sets = [brute_shingles(t) for _, t in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if alike(sets[i], sets[j]) >= 0.8]
    label = components(range(len(rows)), links)
    want = {rows[i][0]: rows[label[i]][0] for i in range(len(rows))}
    near = corpus_pipeline.NEAR
    assert want != {i: c for i, _, c in brute(rows, near=near)}
    assert {i: c for i, _, c in run(spark, rows, near=near)} == want


def test_texts_that_share_a_little_are_not_paired(spark, monkeypatch):
    """Every text shares some shingles with each of many others; a fifth of its own that nobody shares keeps it apart."""
    rows, made = [], {}
    for i in range(60):
        own = [f"own{i}x{j}" for j in range(120)]
        lines = [f"line{min(i, k)}y{max(i, k)} " + " ".join(f"v{min(i, k)}y{max(i, k)}z{j}" for j in range(4)) for k in range(60) if k != i and (i + k) % 3 == 0]
        rows.append((i, " ".join([*own, *lines])))
    rows += [(100 + i, rows[i][1] + " end") for i in range(5)]
    stored = simhash.stored

    def counted(df, name):
        out = stored(df, name)
        made[name] = made.get(name, 0) + (out.count() if name == "met" else 0)
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    sets = [brute_shingles(t) for _, t in rows]
    label = components(range(len(rows)), [(i, j) for i, j in combinations(range(len(rows)), 2) if alike(sets[i], sets[j]) >= 0.8])
    assert {i: c for i, _, c in run(spark, rows, near=corpus_pipeline.NEAR)} == {rows[i][0]: rows[label[i]][0] for i in range(len(rows))}
    assert made["met"] <= 20


def test_shingles_are_not_stored(spark, monkeypatch):
    """What is stored for exact links follows the texts, not their shingles, nearly all of which one text has alone."""
    rows = [(i, " ".join(f"own{i}x{j}" for j in range(1000))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(5)] + [(200, rows[7][1])]
    stored, longs = simhash.stored, []

    def counted(df, name):
        out = stored(df, name)
        arrays = [f.name for f in out.schema if f.dataType.typeName() == "array"]
        longs.append(sum(sum(r) for r in out.select(*[F.size(c) for c in arrays]).collect()) if arrays else out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    want = {i: i - 100 if 100 <= i < 200 else 7 if i == 200 else i for i, _ in rows}
    assert {i: c for i, _, c in run(spark, rows, near=corpus_pipeline.NEAR)} == want
    assert sum(longs) < 1000 * len(rows) / 2


def test_odd_bits_tell_no_more_than_the_sets(spark):
    import numpy as np

    rng, rows = np.random.default_rng(3), []
    for n in (1, 20, 60, 70, 1000, 9000):
        pool = rng.integers(0, 1 << 64, 3 * n, dtype="u8")
        for m in (n, max(n * 4 // 5, 1), n + n // 4, 3 * n):
            x, y = np.unique(pool[:n]), np.unique(pool[n // 10 :][:m])
            rows.append((*(simhash._odd(z).view("<i8").tolist() for z in (x, y)), len(np.setxor1d(x, y))))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, n int")
    got = df.select(simhash._differ(F.col("a"), F.col("b")).alias("d"), "n").collect()
    assert all(r.d <= r.n for r in got) and sum(r.d > r.n / 3 for r in got) > len(got) / 3


def test_one_row_of_a_repeated_id_stays_the_same_in_every_run(spark):
    rows = [(1, f"text number {i} of the same id", i) for i in range(20)] + [(2, "another one", 7)]
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(parts)
        assert sorted(map(tuple, simhash.keep_one(docs).collect())) == [rows[0], rows[-1]]
        assert sorted(map(tuple, simhash.keep_one(docs, simhash.Near()).collect())) == [rows[0], rows[-1]]


def test_chunks_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(str(i * i) for i in range(1000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole


def test_groups_equal_brute_force(spark):
    base = "the law of the land is what the judges say it is and nothing more can be said of it here " * 6
    rows = [(10, base), (3, base), (3, base), (7, base + "end"), (8, base + "end of it"), (20, None), (21, ""), (22, "  ")]
    rows += [(30, "short"), (31, "short text"), (32, "Short Text"), (None, base), (None, "nobody knows this text at all"), (None, None)]
    rows += [(40 + i, base.replace("law", f"law{i}", 1)) for i in range(12)]
    assert order(run(spark, rows)) == order(brute(rows))


def test_links_of_planted_fingerprints(spark):
    import random

    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps)[:12]:
        for _ in range(20):
            g = f
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(simhash._signed(f) for f in fps)
    links = [(a, b) for a, b in combinations(fps, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 2]
    want = components(fps, links)
    df = spark.createDataFrame([(f,) for f in fps] + [(None,)], "fp long")
    edges = simhash.fingerprint_links(df).collect()
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 2 for a, b in edges)
    assert components(fps, [tuple(e) for e in edges]) == want
    with pytest.raises(ValueError):
        simhash.fingerprint_links(df, 3)


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(7, 7), (None, 3), (201, 200), (200, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 5 for i in range(5, 40)} | {200: 200, 201: 200}
    assert got == want
    assert connected_components(df.limit(0)).count() == 0


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 9, 9)], "doc_id long, text string, fp long, component long")
    assert simhash.simhash_groups(docs).count() == 1
    assert simhash.simhash_groups(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns


def test_keep_one_leaves_one_of_each_group(spark):
    base = "the law of the land is what the judges say it is and nothing more can be said of it here " * 6
    rows = [(10, base), (3, base), (3, base), (7, "another text stands here alone"), (None, base), (None, "lone text of nobody"), (None, "lone text of nobody")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert order((r.doc_id, r.text) for r in kept) == order([(3, base), (7, rows[3][1]), (None, "lone text of nobody")])
    assert sorted(str(r.doc_id) for r in kept) == ["3", "7", "None"]
