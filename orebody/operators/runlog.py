"""Run logs, feedback, experiments and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_share, hmac_sha256
from ..session import shared_dir
from .prefix import running


def allowed(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Only the listed columns that exist: free text never leaves by accident."""
    return rows.select(*[c for c in columns if c in rows.columns])


def failure_stage(status: Column, retrieved: Column, photo: Column) -> Column:
    """Where a run failed, by its status and the ids it retrieved; null where it did not."""
    return (
        F.when(status.isin("service_unavailable", "timeout", "interrupted", "invalid_image"), "service").when(status == "verification_failed", "verification")
        .when(photo & (status == "not_matched"), "vision")
        .when(status == "insufficient_evidence", F.when(F.coalesce(F.size(retrieved), F.lit(0)) <= 0, "retrieval").otherwise("generation"))
    )


def with_defaults(runs: DataFrame) -> DataFrame:
    """Runs (status, failure_stage, review, retrieved, photo) with what a write fills in where null."""
    status = F.coalesce("status", F.lit("unknown"))
    return runs.withColumns({
        "failure_stage": F.coalesce("failure_stage", failure_stage(status, F.col("retrieved"), F.col("photo"))), "status": status, "review": F.coalesce("review", F.lit("pending")),
    })


def review_page(one: DataFrame, two: DataFrame, feedback: DataFrame, before: tuple | None, size: int) -> DataFrame:
    """A page of two logs, newest first by (created_at, id), after the cursor ``before``, with its feedback.

    The next cursor is the last row's key.
    """
    rows = one.unionByName(two)
    if before:
        at, key = F.lit(before[0]), F.lit(before[1])
        rows = rows.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < key)))
    page = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(size)
    notes = feedback.groupBy("id").agg(F.count("*").alias("notes"))
    return page.join(notes, "id", "left").withColumn("notes", F.coalesce("notes", F.lit(0)))


def recovered(runs: DataFrame, claims: DataFrame) -> DataFrame:
    """Runs (id, status): what was running is interrupted; a pending claim (id) without a run gets one."""
    now = runs.select("id", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")).alias("status"))
    lost = claims.join(runs.select("id"), "id", "left_anti").select("id", F.lit("interrupted").alias("status"))
    return now.unionByName(lost)


def idempotent(requests: DataFrame) -> DataFrame:
    """Requests (session, request, fingerprint, id): the first runs, equal ones replay it, others conflict."""
    first = requests.groupBy("session", "request").agg(F.min_by("fingerprint", "id").alias("f"), F.min("id").alias("first"))
    both = requests.join(first, ["session", "request"])
    outcome = F.when(F.col("id") == F.col("first"), "run").when(F.col("fingerprint") == F.col("f"), "replay").otherwise("conflict")
    return both.select("id", "session", "request", "first", outcome.alias("outcome"))


def interactions(actions: DataFrame, last: int = 20) -> DataFrame:
    """Actions (session, id, action, item, allowed_items): allowed ones, repeats in a row once, the last ``last`` of a session."""
    ok = actions.where(F.array_contains("allowed_items", F.col("item")))
    w = Window.partitionBy("session").orderBy("id")
    now = F.struct("action", "item")
    moved = ok.withColumn("was", F.lag(now).over(w)).where(F.col("was").isNull() | (F.col("was") != now))
    return moved.withColumn("k", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("id")))).where(F.col("k") <= last).select("session", "id", "action", "item")


def retakes(photos: DataFrame, most: int = 1, max_rounds: int = 40) -> DataFrame:
    """Photos (id, parent, status) with ``retakes``: the parent's count plus one unless the parent failed as a service; ``allowed`` up to ``most``.

    A chain is followed to its end, by pointer jumping: each round every photo looks twice
    as far up, so a chain of n links takes about log2(n) rounds, each cut by a checkpoint.
    A parent that is not there ends a chain.  A chain that runs in a circle raises.
    """
    shared_dir(photos.sparkSession)
    p = photos.select(F.col("id").alias("up"), F.when(F.col("status") == "service", 0).otherwise(1).alias("step"))
    now = photos.select("id", F.col("parent").alias("up")).join(p, "up", "left")
    now = now.select("id", F.when(F.col("step").isNotNull(), F.col("up")).alias("up"), F.coalesce("step", F.lit(0)).cast("long").alias("retakes")).checkpoint()
    for _ in range(max_rounds):
        if not now.where("up is not null").limit(1).count():
            return now.select("id", "retakes", (F.col("retakes") <= most).alias("allowed"))
        far = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("retakes").alias("more"))
        now = now.join(far, "up", "left").select("id", F.col("next").alias("up"), (F.col("retakes") + F.coalesce("more", F.lit(0))).alias("retakes")).checkpoint()
    raise ValueError("photos are parents of each other in a circle")


def reviewed(runs: DataFrame, reviews: DataFrame, regression_runs: DataFrame) -> DataFrame:
    """Runs (id, status, stage) overridden by reviews (id, new_status, new_stage, regression); ``problem`` where the linked run is unknown."""
    known = regression_runs.select(F.col("id").alias("regression"), F.lit(True).alias("known"))
    r = reviews.join(known, "regression", "left").withColumn("bad", F.col("regression").isNotNull() & F.col("known").isNull())
    both = runs.join(r, "id", "left")
    use = ~F.coalesce("bad", F.lit(False))
    return both.select(
        "id", F.when(use, F.coalesce("new_status", "status")).otherwise(F.col("status")).alias("status"), F.when(use, F.coalesce("new_stage", "stage")).otherwise(F.col("stage")).alias("stage"),
        F.when(~use, "unknown regression run").alias("problem"),
    )


def anonymous(rows: DataFrame, ids: tuple[str, ...], salt: str, columns: tuple[str, ...]) -> DataFrame:
    """Listed columns only, identifiers replaced by the first 24 hex digits of their HMAC-SHA-256 under ``salt``; null ones stay null."""
    made = [F.substring(hmac_sha256(F.col(c).cast("string"), salt.encode()), 1, 24).alias(c) if c in ids else F.col(c) for c in columns]
    return rows.select(*made)


def phase_times(events: DataFrame, phases: tuple[str, ...]) -> DataFrame:
    """``run`` with total milliseconds and calls of each phase."""
    cells = []
    for p in phases:
        mine = F.col("phase") == p
        cells += [F.round(F.sum(F.when(mine, F.col("ms")).otherwise(0.0)), 6).alias(f"{p}_ms"), F.sum(mine.cast("long")).alias(f"{p}_calls")]
    return events.groupBy("run").agg(*cells)


def costs(calls: DataFrame, prices: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Token sums and cost of calls (model, hit, miss, out) a model; an unknown price makes the cost null, not 0."""
    sums = calls.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("hit", "miss", "out")])
    cost = F.lit(None).cast("double")
    for model, (h, m, o) in prices.items():
        cost = F.when(F.col("model") == model, (F.col("hit") * h + F.col("miss") * m + F.col("out") * o) / 1e6).otherwise(cost)
    return sums.withColumn("cost", F.round(cost, 9))


def histogram(requests: DataFrame, by: str, value: str, low: float, high: float, buckets: int) -> DataFrame:
    """Counts of ``value`` in equal buckets, below (0) and above (buckets + 1) included."""
    return requests.groupBy(by, F.expr(f"width_bucket({value}, {low}D, {high}D, {buckets}L)").alias("bucket")).agg(F.count("*").alias("n"))


def feedback_union(explicit: DataFrame, implicit: DataFrame, automatic: DataFrame) -> DataFrame:
    """(id, signal, kind, status): all three sources, pending until consumed."""
    rows = None
    for kind, part in (("explicit", explicit), ("implicit", implicit), ("auto", automatic)):
        one = part.select("id", "signal", F.lit(kind).alias("kind"), F.when(F.col("consumed"), "consumed").otherwise("pending").alias("status"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def adoption(feedback: DataFrame, by: str) -> DataFrame:
    """up / max(up + down, 1)."""
    up, down = F.sum((F.col("signal") == "up").cast("long")), F.sum((F.col("signal") == "down").cast("long"))
    return feedback.groupBy(by).agg(F.round(up / F.greatest(up + down, F.lit(1)), 6).alias("rate"))


def follow_ups(messages: DataFrame) -> DataFrame:
    """User turns whose session's message before is the assistant's: ``session``, ``seq``."""
    w = Window.partitionBy("session").orderBy("seq")
    return messages.withColumn("was", F.lag("role").over(w)).where("role = 'user' and was = 'assistant'").select("session", "seq")


def auto_signal(passed: Column, confidence: Column, least: float = 0.6) -> Column:
    """The feedback of a verifier's verdict: failed, low confidence, or none."""
    return F.when(~passed, "verify_fail").when(confidence < least, "low_confidence")


def bad_cases(feedback: DataFrame, signals: tuple[str, ...]) -> DataFrame:
    """Counts and the heuristic root cause of each bad signal."""
    cause = F.when(F.col("signal") == "verify_fail", "evidence").when(F.col("signal") == "low_confidence", "retrieval").otherwise("answer")
    return feedback.where(F.col("signal").isin(*signals)).groupBy("signal").agg(F.count("*").alias("n")).withColumn("cause", cause)


def rule_suggestions(rows: DataFrame, most: int = 50) -> DataFrame:
    """The first occurrence of each rule text (id, dept, text) with a title of 20 characters; the first ``most`` by id are made rules."""
    first = rows.groupBy("text").agg(F.min("id").alias("id"), F.min_by("dept", "id").alias("dept"))
    return first.orderBy("id").limit(most).select("id", "dept", F.substring("text", 1, 20).alias("title"), "text")


def appended_rubric(rubric: Column, new: Column) -> Column:
    return F.array_union(rubric, new)


def cycle_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts (kind) before and after a cycle and their difference."""
    n = lambda t, name: t.groupBy("kind").agg(F.count("*").alias(name))
    both = n(before, "before").join(n(after, "after"), "kind", "full_outer").na.fill(0)
    return both.withColumn("diff", F.col("after") - F.col("before"))


def skill_versions(skills: DataFrame) -> DataFrame:
    """``version`` by name in order of id, and what each replaces."""
    w = Window.partitionBy("name").orderBy("id")
    return skills.select("id", "name", F.row_number().over(w).alias("version"), F.lag("id").over(w).alias("replaces"))


def experiment_arm(percent: Column, *parts: Column) -> Column:
    """treatment where the stable share of the parts is below the clamped percentage."""
    return F.when(hash_share(*parts) < F.greatest(F.lit(0.0), F.least(percent / 100, F.lit(1.0))), "treatment").otherwise("control")


def with_outcomes(executions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Executions (id) with the last outcome that names them (execution_ids, success, at)."""
    each = outcomes.select(F.explode("execution_ids").alias("id"), "success", "at").groupBy("id").agg(F.max_by("success", "at").alias("success"))
    return executions.join(each, "id", "left")


def read_out(executions: DataFrame, least: int = 10, margin: float = 0.1) -> DataFrame:
    """Executions (experiment, arm, success) by experiment: rates, and rollback where both arms are full and treatment + margin < control."""
    done = F.col("success").isNotNull()
    n = lambda arm: F.sum((done & (F.col("arm") == arm)).cast("long"))
    rate = lambda arm: F.round(F.avg(F.when(F.col("arm") == arm, F.col("success").cast("int"))), 6)
    got = executions.groupBy("experiment").agg(n("treatment").alias("n_t"), n("control").alias("n_c"), rate("treatment").alias("treatment"), rate("control").alias("control"))
    full = (F.col("n_t") >= least) & (F.col("n_c") >= least)
    return got.withColumn("rollback", F.coalesce(full & (F.col("treatment") + margin < F.col("control")), F.lit(False)))


def replay_summary(pairs: DataFrame, by: str) -> DataFrame:
    """Means of (baseline, candidate), their difference, and whether the candidate is no worse."""
    got = pairs.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("baseline"), 6).alias("baseline"), F.round(F.avg("candidate"), 6).alias("candidate"))
    return got.withColumn("delta", F.round(F.col("candidate") - F.col("baseline"), 6)).withColumn("passed", (F.col("n") > 0) & (F.col("candidate") >= F.col("baseline")))


def skill_usage(executions: DataFrame) -> DataFrame:
    return executions.groupBy("skill").agg(F.count("*").alias("triggers"), F.sum(F.col("success").cast("long")).alias("successes"), F.round(F.avg(F.col("success").cast("int")), 6).alias("rate"), F.max("at").alias("last"))


def lifecycle(skills: DataFrame, proposals: DataFrame, now: Column) -> DataFrame:
    """Skills (skill, triggers, rate, created_at): stale if rare and old; else a split proposal if frequent and poor, unless one is pending."""
    rare = (F.col("triggers") < 5) & (F.col("created_at") < now - F.expr("INTERVAL 14 DAYS"))
    poor = (F.col("triggers") >= 20) & (F.col("rate") < 0.6)
    marked = skills.withColumn("fate", F.when(rare, "rare").when(poor, "poor").otherwise("active"))
    pending = proposals.select("skill", F.lit(True).alias("pending"))
    both = marked.join(pending, "skill", "left")
    return both.select("skill", "fate", F.when(F.col("fate") == "active", "active").otherwise("stale").alias("status"), ((F.col("fate") == "poor") & F.col("pending").isNull()).alias("propose_split"))


def deployed(items: DataFrame, phase: str, least: float) -> DataFrame:
    """Pending items (id, confidence, replaces, status) that go live by phase and confidence; what a live one replaces is deprecated."""
    if phase == "human_in_loop":
        return items.select("id", "status")
    live = (F.col("status") == "pending") & (F.lit(phase == "human_out_of_loop") | (F.coalesce("confidence", F.lit(0.0)) >= least))
    marked = items.withColumn("now", F.when(live, "active").otherwise(F.col("status")))
    replaced = marked.where(live & F.col("replaces").isNotNull()).select(F.col("replaces").alias("id"), F.lit(True).alias("gone")).distinct()
    both = marked.join(replaced, "id", "left")
    return both.select("id", F.when(F.coalesce("gone", F.lit(False)) & (F.col("now") == "active"), "deprecated").otherwise(F.col("now")).alias("status"))


def review_orders(verdicts: DataFrame) -> DataFrame:
    """Orders (order, n, index, correct): missing and extra verdict indexes and the accuracy over those asked for."""
    held = verdicts.groupBy("order", "n").agg(F.array_sort(F.collect_set("index")).alias("seen"), F.sum(F.when(F.col("index") < F.col("n"), F.col("correct").cast("int"))).alias("right"))
    asked = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    missing, extra = F.array_except(asked, "seen"), F.array_except("seen", asked)
    return held.select("order", missing.alias("missing"), extra.alias("extra"), ((F.size(missing) == 0) & (F.size(extra) == 0)).alias("complete"), F.round(F.col("right") / F.col("n"), 6).alias("accuracy"))


def phases(reviews: DataFrame, least: float = 0.8, samples: int = 5) -> DataFrame:
    """Reviews (dept, at, total, correct): cumulative accuracy, the phase after each, and whether it changed.

    ``at`` tells a department's reviews apart.  Totals are running ones by ranges, so a
    department with most reviews is spread over many tasks; the phase before a review
    follows from the totals without it.
    """
    rows = running(reviews, ["dept"], ["at"], {"__n": "total", "__right": "correct", "__k": F.lit(1)})

    def phase(n: Column, right: Column) -> tuple[Column, Column]:
        accuracy = F.round(right / F.greatest(n, F.lit(1)), 4)
        good = accuracy >= least
        return accuracy, F.when(good & (n >= samples), "human_out_of_loop").when(good, "human_on_loop").otherwise("human_in_loop")

    n, right = F.col("__n"), F.col("__right")
    accuracy, now = phase(n, right)
    _, before = phase(n - F.coalesce("total", F.lit(0)), right - F.coalesce("correct", F.lit(0)))
    was = F.when(F.col("__k") > 1, before).otherwise("human_in_loop")
    return rows.select("dept", "at", n.alias("n"), accuracy.alias("accuracy"), now.alias("phase"), (now != was).alias("changed"))


def exit_samples(docs: DataFrame, percent: float) -> DataFrame:
    """Documents (doc, dept, error) sampled after exit by a hash of their id; any error demotes the department."""
    picked = docs.where(hash_share(F.col("doc").cast("string")) < percent / 100)
    return picked.groupBy("dept").agg(F.count("*").alias("sampled"), F.bool_or("error").alias("demote"))


def questions(chunks: DataFrame, n: int = 3) -> DataFrame:
    """One question for each of the first ``n`` chunks (doc, chunk, title)."""
    k = F.row_number().over(Window.partitionBy("doc").orderBy("chunk"))
    return chunks.withColumn("k", k).where(F.col("k") <= n).select("doc", "chunk", F.format_string("%s: what does part %d say?", "title", "k").alias("question"))


def department_board(depts: DataFrame, docs: DataFrame, chunks: DataFrame, skills: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Counts for each dept: documents, chunks, skills of its own or global, conflicts at either end (once each)."""
    n = lambda t, name: t.groupBy("dept").agg(F.count("*").alias(name))
    ends = conflicts.select(F.col("src").alias("dept"), "id").union(conflicts.select(F.col("dst").alias("dept"), "id")).distinct()
    global_ = skills.where("dept is null").agg(F.count("*").alias("g"))
    out = depts.join(n(docs, "docs"), "dept", "left").join(n(chunks, "chunks"), "dept", "left").join(n(skills.where("dept is not null"), "own"), "dept", "left").join(n(ends, "conflicts"), "dept", "left").crossJoin(F.broadcast(global_)).na.fill(0)
    return out.select("dept", "docs", "chunks", (F.col("own") + F.col("g")).alias("skills"), "conflicts")


def insights(log: DataFrame, signals: tuple[str, ...]) -> DataFrame:
    """One row: distinct sessions, runs, and a count for each of a fixed list of signals."""
    return log.agg(F.count_distinct("session").alias("sessions"), F.count("*").alias("runs"), *[F.sum((F.col("signal") == s).cast("long")).alias(s) for s in signals])
