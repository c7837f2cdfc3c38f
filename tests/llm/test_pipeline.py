import random

import corpus_pipeline as pipe
import pytest

from orebody.llm import quality_cnn
from tests.llm import test_cube_mix, test_decontaminate, test_secret_scan, test_simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(12)
LEX = [f"wo{i}rd" for i in range(300)]


def prose(n):
    return " ".join(RNG.choice(LEX) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    items = [(i, prose(30)) for i in range(5)]
    docs = [(i, prose(RNG.choice([5, 40, 200]))) for i in range(220)]
    docs += [(300 + i, prose(3) + " " + " ".join(f"{RNG.choice(LEX).upper()}!!" for _ in range(80))) for i in range(60)]
    docs += [(400 + i, docs[i][1]) for i in range(15)] + [(500 + i, docs[20 + i][1] + " end") for i in range(15)]
    docs += [(600 + i, prose(20) + " " + items[i][1] + " " + prose(10)) for i in range(5)] + [(700, prose(300) + items[0][1])]
    docs += [(800 + i, prose(30) + ' token = "' + "".join(RNG.choice("0123456789abcdef") for _ in range(40)) + '" ' + prose(30)) for i in range(6)]
    docs += [(900, ""), (901, None), (None, prose(25))]
    rows = [(i, t, "en", RNG.choice(["a", "a", "a", "b", None]), len(t or "")) for i, t in docs]
    labels = [(i, 1, 0) for i in range(150)] + [(300 + i, 0, 0) for i in range(45)]
    spark.createDataFrame(rows, COLUMNS).coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows, items


def brute(spark, at, rows, items):
    docs = spark.read.parquet(f"{at}/documents.parquet")
    net = quality_cnn.fit(docs, spark.read.parquet(f"{at}/labels.parquet"))
    rows = [r for r in rows if net.score((r[1] or "").encode()) >= 0.3]
    first = rows
    groups = test_simhash.brute([(r[0], r[1]) for r in rows], near=pipe.NEAR)
    rows = [r for r, g in zip(rows, groups, strict=True) if r[0] == g[2]]
    bad = test_decontaminate.brute([(r[0], r[1]) for r in rows], items)
    rows = [r for r, b in zip(rows, bad, strict=True) if not b[4]]
    out = []
    for r in rows:
        text, at_, made = r[1], 0, ""
        for a, _, b in test_secret_scan.brute(text)[1]:
            if a >= at_:
                made += text[at_:a] + "[SECRET]"
            at_ = max(at_, b)
        made = None if text is None else made + text[at_:]
        out.append((*r[:1], made, *r[2:4], r[4] if made == text else len(made)))
    return first, out


def test_pipeline_equals_brute_force(spark, tables):
    at, rows, items = tables
    first, want = brute(spark, at, rows, items)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for k, (_, stage) in enumerate(pipe.STAGES[:-1]):
        docs = pipe.stored(stage(spark, docs, at), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 0:
            assert sorted(map(tuple, docs.collect()), key=str) == sorted(first, key=str)
            assert not {300, 310, 359} & {r[0] for r in first} and {0, 1, 2, 219} <= {r[0] for r in first}
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(want, key=str)
    every = pipe.cube_mix.mix(docs).collect()
    test_cube_mix.check([(r[0], r[1], r[3]) for r in want], every)
    final = pipe.run(spark, at).collect()
    assert sorted((str(r.doc_id), r.copies, r.taken) for r in final) == sorted((str(r.id), r.copies, r.taken) for r in every if r.copies)


def test_stages_on_empty_tables(spark, tables):
    at, _, _ = tables
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in pipe.STAGES:
        docs = stage(spark, docs, at)
        assert docs.count() == 0


def test_stages_keep_columns_of_names_that_operators_use(spark, tables):
    at, _, _ = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    names = ("id", "key", "fp", "fps", "check", "component", "label", "y", "score", "term", "size", "copies", "spans", "base")
    more = docs.withColumns({n: pipe.F.concat(pipe.F.lit(f"{n}:"), pipe.F.coalesce(pipe.F.col("doc_id").cast("string"), pipe.F.lit("none"))) for n in names})
    want = docs
    for _, stage in pipe.STAGES[:2] + pipe.STAGES[3:4]:
        more, want = pipe.stored(stage(spark, more, at), "more"), pipe.stored(stage(spark, want, at), "want")
        assert more.columns == [*docs.columns, *names]
        rows = more.collect()
        assert sorted(map(str, (tuple(r[c] for c in docs.columns) for r in rows))) == sorted(map(str, map(tuple, want.collect())))
        assert all(r[n] == f"{n}:{'none' if r.doc_id is None else r.doc_id}" for r in rows for n in names)
    clean = pipe.benchmark_free(spark, more, at)
    assert clean.columns == more.columns and clean.count() == pipe.benchmark_free(spark, want, at).count()
