"""Evaluation: ranks against gold, paired comparisons, gates, grades, samples.

Unknown is not zero: a ratio without a denominator, a rank without gold and a total with
a missing part are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifier_key
from .cleaning import label_lines
from .expand import tasks_for
from .prefix import percentiles as exact

MISSING = 99


def ratio(numerator: Column, denominator: Column) -> Column:
    """Rounded quotient; null where the denominator is 0."""
    return F.round(F.when(denominator != 0, numerator / denominator), 6)


def first_ranks(ranked: DataFrame, gold: DataFrame, by: tuple[str, ...] = ("arm",)) -> DataFrame:
    """*by, ``case``, ``n_gold``, ``rank`` (of the best gold; null if none was found), ``hit1``, ``hit5`` (gold within)."""
    n = gold.groupBy("case").agg(F.count("*").alias("n_gold"))
    best = ranked.groupBy(*by, "case", "doc").agg(F.min("rank").alias("rank"))
    marked = best.join(gold.withColumn("is_gold", F.lit(True)), ["case", "doc"], "left").withColumn("g", F.coalesce("is_gold", F.lit(False)))
    within = lambda k: F.sum((F.col("g") & (F.col("rank") <= k)).cast("int"))
    got = marked.groupBy(*by, "case").agg(F.min(F.when(F.col("g"), F.col("rank"))).alias("rank"), within(1).alias("hit1"), within(5).alias("hit5"))
    return got.join(n, "case", "left")


def recall(ranks: DataFrame) -> DataFrame:
    """Recall at 1 and 5 and reciprocal rank of each case; null without gold."""
    known = F.col("n_gold").isNotNull()
    return ranks.select(
        "arm", "case", ratio(F.col("hit1"), F.col("n_gold")).alias("recall1"), ratio(F.col("hit5"), F.col("n_gold")).alias("recall5"),
        F.when(known, F.round(F.coalesce(1 / F.col("rank"), F.lit(0.0)), 6)).alias("rr"),
    )


def arm_summary(ranks: DataFrame, times: DataFrame) -> DataFrame:
    """Top1, Top5, Top25, MRR@5 over cases with gold and nearest-rank p50, p95 of ``ms`` of each arm."""
    top = lambda k: F.sum((F.coalesce(F.col("rank") <= k, F.lit(False))).cast("long")).alias(f"top{k}")
    rr5 = F.when(F.col("rank") <= 5, 1 / F.col("rank")).otherwise(0.0)
    got = ranks.where("n_gold is not null").groupBy("arm").agg(F.count("*").alias("cases"), top(1), top(5), top(25), F.round(F.avg(rr5), 6).alias("mrr5"))
    t = exact(times, ["arm"], "ms", {"p50": 0.5, "p95": 0.95})
    return got.join(t, "arm")


def stage_ranks(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """``case``: best gold chunk rank, whether within 25, distinct documents."""
    n = tasks_for(ranked)
    marked = ranked.repartition(n, "case", "doc").join(gold.withColumn("g", F.lit(True)).repartition(n, "case", "doc"), ["case", "doc"], "left")
    best = F.min(F.when(F.col("g"), F.col("rank")))
    return marked.repartition(n, "case").groupBy("case").agg(best.alias("chunk_rank"), F.coalesce(best <= 25, F.lit(False)).alias("in25"), F.count_distinct("doc").alias("works"))


def paired(ranks: DataFrame, before: str, after: str) -> DataFrame:
    """``case``, ``rank_before``, ``rank_after`` (missing: 99), ``has_gold``."""
    rank = F.coalesce("rank", F.lit(MISSING))
    one = lambda arm, name: ranks.where(F.col("arm") == arm).select("case", rank.alias(name), F.col("n_gold").isNotNull().alias("has_gold"))
    return one(before, "rank_before").join(one(after, "rank_after").drop("has_gold"), "case")


def changes(pairs: DataFrame, k: int = 5) -> DataFrame:
    """``case``, ``change``: fixed, regressed at ``k``, or same."""
    b, a = F.col("rank_before") <= k, F.col("rank_after") <= k
    return pairs.select("case", F.when(~b & a, "fixed").when(b & ~a, "regressed").otherwise("same").alias("change"))


def comparison(pairs: DataFrame, tops: DataFrame, before: str, after: str) -> DataFrame:
    """``case``, ``lost_top5``, ``worse``, ``same_order``, ``same_set``; ``tops`` has (arm, case, docs)."""
    of = lambda arm, name: tops.where(F.col("arm") == arm).select("case", F.slice("docs", 1, 5).alias(name))
    rows = pairs.join(of(before, "b"), "case").join(of(after, "a"), "case")
    return rows.select(
        "case", ((F.col("rank_before") <= 5) & (F.col("rank_after") > 5)).alias("lost_top5"), (F.col("rank_after") > F.col("rank_before")).alias("worse"),
        (F.col("a") == F.col("b")).alias("same_order"), (F.array_sort("a") == F.array_sort("b")).alias("same_set"),
    )


def group_summary(pairs: DataFrame) -> DataFrame:
    """Top1, Top5, MRR@5 before and after, lost and worse of each ``group``, and of all (``group`` is ``total``)."""

    def stats(side: str) -> list[Column]:
        r = F.col(f"rank_{side}")
        return [F.sum((r <= k).cast("long")).alias(f"top{k}_{side}") for k in (1, 5)] + [F.round(F.avg(F.when(r <= 5, 1 / r).otherwise(0.0)), 6).alias(f"mrr5_{side}")]

    lost = F.sum(((F.col("rank_before") <= 5) & (F.col("rank_after") > 5)).cast("long")).alias("lost")
    worse = F.sum((F.col("rank_after") > F.col("rank_before")).cast("long")).alias("worse")
    return pairs.rollup("group").agg(F.count("*").alias("cases"), *stats("before"), *stats("after"), lost, worse).withColumn("group", F.coalesce("group", F.lit("total")))


def example_coverage(tops: DataFrame, known: DataFrame) -> DataFrame:
    """How many known examples (case, docs) the five best hold: ``case``, ``covered``, ``known``."""
    both = tops.select("case", F.slice("docs", 1, 5).alias("d")).join(known, "case")
    return both.select("case", F.size(F.array_intersect("d", "docs")).alias("covered"), F.size(F.array_distinct("docs")).alias("known"))


def section_summary(ranks: DataFrame) -> DataFrame:
    """``section``: cases, those without gold, hits at 5 among the others."""
    none = F.col("n_gold").isNull()
    return ranks.groupBy("section").agg(F.count("*").alias("cases"), F.sum(none.cast("long")).alias("no_gold"), F.sum((~none & F.coalesce(F.col("rank") <= 5, F.lit(False))).cast("long")).alias("hits"))


def facet_gold(works: DataFrame, label: str, needles: tuple[str, ...]) -> DataFrame:
    """Works whose ``label`` lines contain every needle."""
    lines = label_lines(works, (label,)).groupBy("work").agg(F.concat_ws("\n", F.collect_list(F.lower("value"))).alias("v"))
    return lines.where(F.forall(F.array(*[F.lit(n.lower()) for n in needles]), lambda n: F.contains(F.col("v"), n))).select("work")


def answer_scores(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Answers (case, doc, snippet, terms, text): whether the cited document is active and holds the snippet, and the share of terms in the text."""
    cited = answers.join(chunks.select("doc", "content", "status"), "doc", "left")
    good = F.coalesce((F.col("status") == "active") & F.contains("content", "snippet"), F.lit(False))
    share = ratio(F.size(F.filter("terms", lambda x: F.contains(F.lower("text"), F.lower(x)))), F.size("terms"))
    return cited.select("case", good.alias("citation_ok"), share.alias("term_coverage"))


def cohort_summary(ranks: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 5, 10, 20)) -> DataFrame:
    """``cohort``: cases, those out of the corpus, Top-k counts and MRR over those inside."""
    inside = F.col("n_gold").isNotNull()
    top = [F.sum((inside & F.coalesce(F.col("rank") <= k, F.lit(False))).cast("long")).alias(f"top{k}") for k in ks]
    return ranks.groupBy("cohort").agg(F.count("*").alias("cases"), F.sum((~inside).cast("long")).alias("outside"), *top, F.round(F.avg(F.when(inside, F.coalesce(1 / F.col("rank"), F.lit(0.0)))), 6).alias("mrr"))


def outcomes(runs: DataFrame) -> DataFrame:
    """Runs (case, mode, status, chosen, expected) counted by mode and outcome: error, wrong, none, correct, browse."""
    outcome = (
        F.when(F.col("status") == "error", "error").when(F.col("chosen").isNull() & F.col("expected").isNull(), "browse").when(F.col("chosen").isNull(), "none")
        .when(F.col("chosen").eqNullSafe(F.col("expected")), "correct").otherwise("wrong")
    )
    kinds = ["error", "wrong", "none", "correct", "browse"]
    return runs.groupBy("mode").agg(*[F.sum((outcome == k).cast("long")).alias(k) for k in kinds])


def percentiles(rows: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Nearest-rank (``d``) and interpolated (``c``) percentiles of ``value``."""
    found = exact(rows, [by], value, {f"d{int(p * 100)}": p for p in shares}, {f"c{int(p * 100)}": p for p in shares})
    return found.withColumns({f"c{int(p * 100)}": F.round(f"c{int(p * 100)}", 6) for p in shares})


def matrix_gaps(runs: DataFrame, cases: DataFrame, modes: DataFrame, repeats: int, most: int = 1000) -> DataFrame:
    """Cells of the full case x mode x repeat matrix that ``runs`` lacks; up to ``most`` modes are broadcast, more are joined without it."""
    modes = modes.select("mode")
    few = modes.limit(most + 1).count() <= most
    full = cases.select("case").crossJoin(F.broadcast(modes) if few else modes).select("case", "mode", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    return full.join(runs.select("case", "mode", "repeat"), ["case", "mode", "repeat"], "left_anti")


def gate(pairs: DataFrame, worst: int = 3) -> DataFrame:
    """One row: ``passed`` if every target is within ``worst`` and none got worse, and how many fail."""
    ok = (F.col("rank_after") <= worst) & (F.col("rank_after") <= F.col("rank_before"))
    return pairs.agg(F.coalesce(F.bool_and(ok), F.lit(False)).alias("passed"), F.coalesce(F.sum((~ok).cast("long")), F.lit(0)).alias("failing"))


def additions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that came and went, repeats counted: ``kind`` and the columns."""
    return after.exceptAll(before).withColumn("kind", F.lit("added")).unionByName(before.exceptAll(after).withColumn("kind", F.lit("removed")))


def same_inputs(runs: DataFrame) -> DataFrame:
    """``case``, ``controlled``: all arms saw the same candidates and scores."""
    return runs.groupBy("case").agg((F.count_distinct("digest") == 1).alias("controlled"))


def graded(tasks: DataFrame) -> DataFrame:
    """Tasks (task, expectation, answer, needle, source, quote) graded mechanically: ``passed``, null where a person must judge."""
    passed = (
        F.when(F.col("expectation") == "refuse", F.col("answer").isNull()).when(F.col("expectation") == "contains", F.coalesce(F.contains("answer", "needle"), F.lit(False)))
        .when(F.col("expectation") == "quote", F.coalesce(F.contains("source", "quote"), F.lit(False)))
    )
    return tasks.select("task", passed.alias("passed"))


def judge_problems(judged: DataFrame) -> DataFrame:
    """``task``, ``problem`` of judgements (task, steps, marks, cited, citations, passed)."""
    checks = (
        ("marks", F.size("marks") != F.col("steps")), ("citations", F.col("cited") > F.col("citations")),
        ("contradiction", F.col("passed") & F.exists("marks", lambda m: m == 0)),
    )
    return judged.select("task", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in checks]))).alias("problem"))


def task_summary(tasks: DataFrame) -> DataFrame:
    """Tasks (category, passed, ms; null ``passed``: not run) by category and in total (null category)."""
    passed, ran = F.col("passed").cast("long"), F.col("passed").isNotNull().cast("long")
    sums = [F.count("*").alias("tasks"), F.sum(1 - ran).alias("unrun"), F.sum(passed).alias("passed"), ratio(F.sum(passed), F.sum(ran)).alias("rate")]
    one = exact(tasks, ["category"], "ms", {"p95": 0.95}).withColumnRenamed("category", "__category")
    each = tasks.groupBy("category").agg(*sums).join(one, F.col("category").eqNullSafe(F.col("__category")), "left").drop("__category")
    total = tasks.agg(*sums).join(exact(tasks, [], "ms", {"p95": 0.95}), F.lit(True), "left")
    return each.unionByName(total.withColumn("category", F.lit(None).cast(dict(tasks.dtypes)["category"])))


def dashboard_rows(pairs: DataFrame, times: DataFrame) -> DataFrame:
    """Metric rows (group, variant, label, value, unit, numerator, denominator) of paired ranks and latencies; ratios are null without cases."""
    out = None
    for side in ("before", "after"):
        for k in (1, 5):
            n, d = F.sum((F.col("scored") & (F.col(f"rank_{side}") <= k)).cast("long")), F.sum(F.col("scored").cast("long"))
            rows = pairs.groupBy("group").agg(n.alias("numerator"), d.alias("denominator")).select("group", F.lit(side).alias("variant"), F.lit(f"Top{k}").alias("label"), ratio(F.col("numerator"), F.col("denominator")).alias("value"), F.lit("ratio").alias("unit"), "numerator", "denominator")
            out = rows if out is None else out.unionByName(rows)
    none = F.lit(None).cast("long")
    lat = exact(times, ["group", "variant"], "ms", {"value": 0.95})
    return out.unionByName(lat.select("group", "variant", F.lit("p95").alias("label"), "value", F.lit("ms").alias("unit"), none.alias("numerator"), none.alias("denominator")))


def human_grades(grades: DataFrame) -> DataFrame:
    """Ratio of good over graded for each (group, variant), by its newest run only."""
    newest = F.max("run").over(Window.partitionBy("group", "variant"))
    rows = grades.withColumn("newest", newest).where("run = newest")
    return rows.groupBy("group", "variant", "run").agg(F.sum("good").alias("good"), F.sum("graded").alias("graded"), ratio(F.sum("good"), F.sum("graded")).alias("ratio"))


def metric_problems(metrics: DataFrame) -> DataFrame:
    """``metric``, ``problem`` of metric rows (metric, unit, value, numerator, denominator)."""
    v, n, d = F.col("value"), F.col("numerator"), F.col("denominator")
    checks = (
        ("not finite", F.isnan(v) | (F.abs(v) == float("inf"))), ("range", (F.col("unit") == "ratio") & ((v < 0) | (v > 1))), ("denominator", n.isNotNull() & (d.isNull() | (d <= 0) | (n > d))),
        ("disagree", (F.col("unit") == "ratio") & (d > 0) & (F.abs(v - n / d) > 1e-6)), ("unit", n.isNotNull() & (F.col("unit") != "ratio")),
    )
    return metrics.select("metric", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks]))).alias("problem"))


def variant_summary(runs: DataFrame) -> DataFrame:
    """``variant``: runs, means of ``recall`` and ``rr`` over non-null ones, p50 and p95 of ``ms``."""
    means = runs.groupBy("variant").agg(F.count("*").alias("runs"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("rr"))
    times = exact(runs, ["variant"], "ms", {"p50": 0.5, "p95": 0.95}).withColumnRenamed("variant", "__variant")
    return means.join(times, F.col("variant").eqNullSafe(F.col("__variant")), "left").drop("__variant")


def round_robin(items: DataFrame, excluded: DataFrame, n: int) -> DataFrame:
    """``n`` items (item, title, work) in rounds over titles, without the works of ``excluded``; every 4th work is holdout."""
    kept = items.join(excluded.select("work"), "work", "left_anti")
    ranked = kept.withColumn("round", F.row_number().over(Window.partitionBy("title").orderBy("item")))
    return ranked.orderBy("round", "title").limit(n).withColumn("holdout", F.pmod(F.xxhash64("work"), F.lit(4)) == 0)


def hash_sample(cases: DataFrame, n: int, key: str = "case") -> DataFrame:
    """A stable sample: the ``n`` cases of least SHA-256."""
    h = F.sha2(F.col(key).cast("string"), 256)
    return cases.select(key, h.alias("h")).orderBy("h").limit(n).select(key)


def image_reasons(works: DataFrame, images: DataFrame) -> DataFrame:
    """``work``, ``reason``: available, no image, not allowed, or file missing."""
    rows = works.select("work").join(images, "work", "left")
    reason = F.when(F.col("path").isNull(), "no image").when(~F.col("allowed"), "not allowed").when(~F.col("present"), "file missing").otherwise("available")
    return rows.select("work", reason.alias("reason"))


def calibration(verdicts: DataFrame) -> DataFrame:
    """Agreement of verdicts (policy, verdict, label) with labels; unlabelled ones are left out."""
    return verdicts.where("label is not null").groupBy("policy").agg(F.count("*").alias("n"), ratio(F.sum((F.col("verdict") == F.col("label")).cast("long")), F.count("*")).alias("agreement"))


def pool_losses(gold: DataFrame, full: DataFrame, reduced: DataFrame) -> DataFrame:
    """Gold that the full pool has and the reduced one lacks."""
    return gold.join(full.select("case", "doc"), ["case", "doc"], "left_semi").join(reduced.select("case", "doc"), ["case", "doc"], "left_anti").select("case", "doc")


def known_total(calls: DataFrame, by: str, value: str) -> DataFrame:
    """Sums of ``value``; null unless every call has one."""
    return calls.groupBy(by).agg(F.count("*").alias("calls"), F.when(F.count(value) == F.count("*"), F.sum(value)).alias("total"))


def ocr_outcome(reads: DataFrame) -> DataFrame:
    """Reads (photo, text, expected, found): whether any line is the expected identifier, and the first stage that failed."""
    keys = F.transform(F.split("text", "\n"), identifier_key)
    key = identifier_key(F.col("expected"))
    read = F.coalesce(F.exists(keys, lambda k: k == key), F.lit(False))
    stage = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "nothing read").when(~read, "misread").when(~F.col("found"), "not found").otherwise("ok")
    return reads.select("photo", read.alias("transcribed"), stage.alias("stage"))


def photo_passes(runs: DataFrame) -> DataFrame:
    """Runs (case, arm, candidates, expected) pass with the exact list, or empty where none is expected; ``comparable`` needs all arms to pass."""
    want = F.coalesce("expected", F.array().cast("array<bigint>"))
    p = runs.select("case", "arm", (F.coalesce("candidates", F.array().cast("array<bigint>")) == want).alias("passed"))
    return p.groupBy("case").agg(F.bool_and("passed").alias("comparable"), F.sum((~F.col("passed")).cast("long")).alias("failures"))


def variant_recall(ranks: DataFrame) -> DataFrame:
    """``variant``: recall at 5 and mean reciprocal rank over cases with gold that are no follow-up."""
    rows = ranks.where("n_gold is not null and not followup")
    return rows.groupBy("variant").agg(F.count("*").alias("cases"), F.round(F.avg(F.coalesce(F.col("rank") <= 5, F.lit(False)).cast("int")), 6).alias("recall5"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def reused(requests: DataFrame, stored: DataFrame, compute) -> DataFrame:
    """Requests (key, ...) answered from ``stored`` (key, result) by exact key; ``compute`` sees the unseen only, once each."""
    new = requests.join(stored.select("key"), "key", "left_anti").dropDuplicates(["key"])
    results = stored.select("key", "result", F.lit(True).alias("reused")).unionByName(compute(new).select("key", "result", F.lit(False).alias("reused")))
    return requests.select("key").join(results, "key")


def dataset_problems(cases: DataFrame, quotas: DataFrame, works: DataFrame) -> DataFrame:
    """``subject``, ``problem`` of a dataset (case, category, reviewer, gold, quote) against quotas (category, quota) and works (work, content)."""
    n = cases.groupBy("category").agg(F.count("*").alias("n"))
    quota = n.join(quotas, "category", "full_outer").where(~F.coalesce(F.col("n") == F.col("quota"), F.lit(False))).select(F.col("category").alias("subject"), F.lit("quota").alias("problem"))
    twice = cases.groupBy("case").agg(F.count("*").alias("n")).where("n > 1").select(F.col("case").cast("string").alias("subject"), F.lit("duplicate").alias("problem"))
    joined = cases.join(works, F.col("gold") == F.col("work"), "left")
    checks = (("no reviewer", F.coalesce("reviewer", F.lit("")) == ""), ("unknown gold", F.col("gold").isNotNull() & F.col("work").isNull()), ("no evidence", F.col("work").isNotNull() & ~F.contains("content", "quote")))
    own = joined.select(F.col("case").cast("string").alias("subject"), F.explode(F.array_compact(F.array(*[F.when(t, F.lit(p)) for p, t in checks]))).alias("problem"))
    return quota.unionByName(twice).unionByName(own)
