"""Evaluation (X): orders are cases, their lines the ranked documents, two orders of them the arms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators.expand import tasks_for
from .registry import Tables, query

#: Rows that tie in every column are interchangeable.
RANKED = """r AS (
  SELECT l_orderkey AS "case", 'before' AS arm, l_partkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey) AS rank FROM lineitem
  UNION ALL SELECT l_orderkey, 'after', l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_extendedprice, l_partkey, l_suppkey) FROM lineitem),
g AS (SELECT DISTINCT l_orderkey AS "case", l_partkey AS doc FROM lineitem WHERE l_discount >= 0.08),
n AS (SELECT "case", count(*) AS n_gold FROM g GROUP BY 1),
b AS (SELECT arm, "case", doc, min(rank) AS rank FROM r GROUP BY ALL),
k AS (SELECT b.arm, b."case", min(CASE WHEN g.doc IS NOT NULL THEN rank END) AS rank, count(*) FILTER (g.doc IS NOT NULL AND rank <= 1) AS hit1, count(*) FILTER (g.doc IS NOT NULL AND rank <= 5) AS hit5
  FROM b LEFT JOIN g USING ("case", doc) GROUP BY ALL),
ranks AS (SELECT * FROM k LEFT JOIN n USING ("case"))"""
PAIRS = f"""{RANKED}, pairs AS (SELECT x."case", coalesce(x.rank, 99) AS rank_before, coalesce(y.rank, 99) AS rank_after, x.n_gold IS NOT NULL AS has_gold FROM ranks x JOIN ranks y USING ("case") WHERE x.arm = 'before' AND y.arm = 'after')"""


def ranked(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").repartition(tasks_for(t.lineitem), "l_orderkey")
    by = lambda arm, *order: lines.select(F.col("l_orderkey").alias("case"), F.lit(arm).alias("arm"), F.col("l_partkey").alias("doc"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).alias("rank"))
    return by("before", "l_extendedprice", "l_partkey", "l_suppkey").unionByName(by("after", "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey"))


def gold(t: Tables):
    n = tasks_for(t.lineitem)
    return t.lineitem.where("l_discount >= 0.08").select(F.col("l_orderkey").alias("case"), F.col("l_partkey").alias("doc")).repartition(n, "case", "doc").distinct()


def ranks(t: Tables):
    return ev.first_ranks(ranked(t), gold(t))


def pairs(t: Tables):
    return ev.paired(ranks(t), "before", "after")


def times(t: Tables, group: str = "arm"):
    return t.events.select(F.when(F.col("event_id") % 2 == 0, "before").otherwise("after").alias("arm"), F.col("event_type").alias("group"), F.col("value").alias("ms"))


def tops(t: Tables):
    held = ranked(t).groupBy("arm", "case").agg(F.array_sort(F.collect_list(F.struct("rank", "doc"))).alias("d"))
    return held.select("arm", "case", F.transform("d", lambda x: x["doc"]).alias("docs"))


TOPS = 'tops AS (SELECT arm, "case", list(doc ORDER BY rank) AS docs FROM r GROUP BY ALL)'


@query("x1_dataset_problems", """
WITH c AS (SELECT p_partkey AS "case", p_type AS category, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'r' END AS reviewer, p_partkey + CASE WHEN p_partkey % 8 = 0 THEN 10000000 ELSE 0 END AS gold, CASE WHEN p_partkey % 7 = 0 THEN 'zzz' ELSE p_name END AS quote, p_name FROM part),
q AS (SELECT p_type AS category, count(*) + CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END AS quota FROM part GROUP BY 1)
SELECT q.category AS subject, 'quota' AS problem FROM q JOIN (SELECT category, count(*) AS n FROM c GROUP BY 1) USING (category) WHERE n <> quota
UNION ALL SELECT "case"::VARCHAR, 'no reviewer' FROM c WHERE reviewer = '' UNION ALL SELECT "case"::VARCHAR, 'unknown gold' FROM c WHERE gold > 9999999
UNION ALL SELECT "case"::VARCHAR, 'no evidence' FROM c WHERE gold < 9999999 AND NOT contains(p_name, quote)""")
def _(t: Tables):
    p = F.col("p_partkey")
    c = t.part.select(p.alias("case"), F.col("p_type").alias("category"), F.when(p % 9 == 0, "").otherwise("r").alias("reviewer"), F.when(p % 8 == 0, p + 10_000_000).otherwise(p).alias("gold"), F.when(p % 7 == 0, "zzz").otherwise(F.col("p_name")).alias("quote"))
    q = t.part.groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("quota")).withColumn("quota", F.col("quota") + F.when(F.col("category") == "ECONOMY", 1).otherwise(0))
    return ev.dataset_problems(c, q, t.part.select(p.alias("work"), F.col("p_name").alias("content")))


@query("x2_recall", f"""WITH {RANKED} SELECT arm, "case", round(hit1 / n_gold, 6) AS recall1, round(hit5 / n_gold, 6) AS recall5, CASE WHEN n_gold IS NOT NULL THEN round(coalesce(1.0 / rank, 0), 6) END AS rr FROM ranks""")
def _(t: Tables):
    return ev.recall(ranks(t))


@query("x3_arms", f"""WITH {RANKED},
s AS (SELECT arm, count(*) AS cases, count(*) FILTER (rank <= 1) AS top1, count(*) FILTER (rank <= 5) AS top5, count(*) FILTER (rank <= 25) AS top25, round(avg(CASE WHEN rank <= 5 THEN 1.0 / rank ELSE 0 END), 6) AS mrr5 FROM ranks WHERE n_gold IS NOT NULL GROUP BY arm),
e AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'before' ELSE 'after' END AS arm, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1)
SELECT * FROM s JOIN e USING (arm)""")
def _(t: Tables):
    return ev.arm_summary(ranks(t), times(t))


@query("x4_stage_ranks", f"""WITH {RANKED} SELECT r."case", min(CASE WHEN g.doc IS NOT NULL THEN rank END) AS chunk_rank, coalesce(min(CASE WHEN g.doc IS NOT NULL THEN rank END) <= 25, false) AS in25, count(DISTINCT r.doc) AS works FROM r LEFT JOIN g USING ("case", doc) WHERE arm = 'before' GROUP BY 1""")
def _(t: Tables):
    return ev.stage_ranks(ranked(t).where("arm = 'before'"), gold(t))


@query("x5_changes", f"""WITH {PAIRS} SELECT "case", CASE WHEN rank_before > 2 AND rank_after <= 2 THEN 'fixed' WHEN rank_before <= 2 AND rank_after > 2 THEN 'regressed' ELSE 'same' END AS change FROM pairs""")
def _(t: Tables):
    return ev.changes(pairs(t), 2)


@query("x6_comparison", f"""WITH {PAIRS}, {TOPS} SELECT "case", rank_before <= 5 AND rank_after > 5 AS lost_top5, rank_after > rank_before AS worse, a.docs[1:5] = b.docs[1:5] AS same_order, list_sort(a.docs[1:5]) = list_sort(b.docs[1:5]) AS same_set
FROM pairs JOIN tops b USING ("case") JOIN tops a USING ("case") WHERE b.arm = 'before' AND a.arm = 'after'""")
def _(t: Tables):
    return ev.comparison(pairs(t), tops(t), "before", "after")


@query("x7_groups", f"""WITH {PAIRS}, p AS (SELECT pairs.*, o_orderpriority AS "group" FROM pairs JOIN orders ON o_orderkey = "case")
SELECT coalesce("group", 'total') AS "group", count(*) AS cases, count(*) FILTER (rank_before <= 1) AS top1_before, count(*) FILTER (rank_before <= 5) AS top5_before, round(avg(CASE WHEN rank_before <= 5 THEN 1.0 / rank_before ELSE 0 END), 6) AS mrr5_before,
 count(*) FILTER (rank_after <= 1) AS top1_after, count(*) FILTER (rank_after <= 5) AS top5_after, round(avg(CASE WHEN rank_after <= 5 THEN 1.0 / rank_after ELSE 0 END), 6) AS mrr5_after, count(*) FILTER (rank_before <= 5 AND rank_after > 5) AS lost, count(*) FILTER (rank_after > rank_before) AS worse FROM p GROUP BY ROLLUP ("group")""")
def _(t: Tables):
    return ev.group_summary(pairs(t).join(t.orders.select(F.col("o_orderkey").alias("case"), F.col("o_orderpriority").alias("group")), "case"))


@query("x8_example_coverage", f"""WITH {RANKED}, {TOPS}, w AS (SELECT "case", list(doc) AS docs FROM g GROUP BY 1) SELECT "case", len(list_intersect(list_distinct(t.docs[1:5]), list_distinct(w.docs))) AS covered, len(list_distinct(w.docs)) AS known FROM tops t JOIN w USING ("case") WHERE arm = 'after'""")
def _(t: Tables):
    return ev.example_coverage(tops(t).where("arm = 'after'"), gold(t).groupBy("case").agg(F.collect_list("doc").alias("docs")))


@query("x9_sections", f"""WITH {RANKED} SELECT o_orderstatus AS section, count(*) AS cases, count(*) FILTER (n_gold IS NULL) AS no_gold, count(*) FILTER (n_gold IS NOT NULL AND rank <= 5) AS hits FROM ranks JOIN orders ON o_orderkey = "case" WHERE arm = 'after' GROUP BY 1""")
def _(t: Tables):
    return ev.section_summary(ranks(t).where("arm = 'after'").join(t.orders.select(F.col("o_orderkey").alias("case"), F.col("o_orderstatus").alias("section")), "case"))


@query("x10_facet_gold", "SELECT p_partkey AS work FROM part WHERE p_name LIKE '%red%' AND p_name LIKE '%ring%'")
def _(t: Tables):
    works = t.part.select(F.col("p_partkey").alias("work"), F.concat(F.lit("Title: x\nName: "), F.initcap("p_name")).alias("content"))
    return ev.facet_gold(works, "Name", ("red", "Ring"))


@query("x11_answers", """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents), a AS (SELECT doc_id, text, substr(text, 1, length(text) // 3) AS snippet FROM d)
SELECT a.doc_id AS "case", coalesce(c.source <> 'src3' AND contains(c.text, snippet), false) AS citation_ok, round((contains(lower(a.text), 'the')::INT + contains(lower(a.text), 'zzz')::INT + contains(lower(a.text), 'de')::INT) / 3, 6) AS term_coverage
FROM a LEFT JOIN d c ON c.doc_id = CASE WHEN a.doc_id % 4 = 0 THEN a.doc_id + 1 ELSE a.doc_id END""")
def _(t: Tables):
    text = F.coalesce("text", F.lit(""))
    d = t.documents.select("doc_id", "source", text.alias("text"))
    snippet = F.substring("text", F.lit(1), F.floor(F.length("text") / 3).cast("int"))
    # Every fourth answer cites the document after its own.
    cited = F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    a = d.select(F.col("doc_id").alias("case"), cited.alias("doc"), snippet.alias("snippet"), F.array(F.lit("The"), F.lit("zzz"), F.lit("de")).alias("terms"), "text")
    return ev.answer_scores(a, d.select(F.col("doc_id").alias("doc"), F.col("text").alias("content"), F.when(F.col("source") == "src3", "archived").otherwise("active").alias("status")))


@query("x12_cohorts", f"""WITH {RANKED} SELECT o_orderpriority AS cohort, count(*) AS cases, count(*) FILTER (n_gold IS NULL) AS outside, {", ".join(f"count(*) FILTER (n_gold IS NOT NULL AND rank <= {k}) AS top{k}" for k in (1, 2, 3, 5, 10, 20))},
round(avg(CASE WHEN n_gold IS NOT NULL THEN coalesce(1.0 / rank, 0) END), 6) AS mrr FROM ranks JOIN orders ON o_orderkey = "case" WHERE arm = 'before' GROUP BY 1""")
def _(t: Tables):
    return ev.cohort_summary(ranks(t).where("arm = 'before'").join(t.orders.select(F.col("o_orderkey").alias("case"), F.col("o_orderpriority").alias("cohort")), "case"))


@query("x13_outcomes", """
WITH o AS (SELECT event_type AS mode, CASE WHEN value > 150 THEN 'error' WHEN user_id % 3 = 0 AND event_id % 4 = 0 THEN 'browse' WHEN user_id % 3 = 0 THEN 'none' WHEN event_id % 4 = 0 THEN 'wrong' WHEN user_id % 3 = event_id % 3 THEN 'correct' ELSE 'wrong' END AS x FROM events)
SELECT mode, count(*) FILTER (x = 'error') AS error, count(*) FILTER (x = 'wrong') AS wrong, count(*) FILTER (x = 'none') AS none, count(*) FILTER (x = 'correct') AS correct, count(*) FILTER (x = 'browse') AS browse FROM o GROUP BY mode""")
def _(t: Tables):
    r = t.events.select(F.col("event_type").alias("mode"), F.when(F.col("value") > 150, "error").otherwise("ok").alias("status"), F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 3).alias("chosen"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 3).alias("expected"))
    return ev.outcomes(r)


@query("x14_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS d50, round(quantile_cont(value, 0.5), 6) AS c50, quantile_disc(value, 0.95) AS d95, round(quantile_cont(value, 0.95), 6) AS c95 FROM events GROUP BY 1")
def _(t: Tables):
    return ev.percentiles(t.events, "event_type", "value")


@query("x15_matrix_gaps", """
SELECT DISTINCT c.user_id AS "case", m.event_type AS mode, r AS repeat FROM (SELECT DISTINCT user_id FROM events) c, (SELECT DISTINCT event_type FROM events) m, (SELECT unnest([1, 2]) AS r)
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.user_id AND e.event_type = m.event_type AND e.event_id % 2 + 1 = r AND e.value > 60)""")
def _(t: Tables):
    runs = t.events.where("value > 60").select(F.col("user_id").alias("case"), F.col("event_type").alias("mode"), (F.col("event_id") % 2 + 1).cast("int").alias("repeat"))
    return ev.matrix_gaps(runs, t.events.select(F.col("user_id").alias("case")).distinct(), t.events.select(F.col("event_type").alias("mode")).distinct(), 2)


@query("x15_gate", f"WITH {PAIRS} SELECT bool_and(rank_after <= 3 AND rank_after <= rank_before) AS passed, count(*) FILTER (NOT (rank_after <= 3 AND rank_after <= rank_before)) AS failing FROM pairs WHERE has_gold")
def _(t: Tables):
    return ev.gate(pairs(t).where("has_gold"))


@query("x16_additions", "SELECT p_brand, p_type, 'added' AS kind FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT p_brand, p_type, 'removed' FROM part WHERE p_partkey % 70 = 1")
def _(t: Tables):
    cols = ("p_partkey", "p_brand", "p_type")
    return ev.additions(t.part.where("p_partkey % 50 <> 0").select(*cols), t.part.where("p_partkey % 70 <> 1").select(*cols)).drop("p_partkey")


@query("x17_same_inputs", 'SELECT event_id // 2 AS "case", count(DISTINCT event_type) = 1 AS controlled FROM events GROUP BY 1')
def _(t: Tables):
    return ev.same_inputs(t.events.select(F.floor(F.col("event_id") / 2).alias("case"), F.sha2("event_type", 256).alias("digest")))


@query("x18_graded", "SELECT p_partkey AS task, CASE p_partkey % 4 WHEN 0 THEN p_size < 10 WHEN 1 THEN p_size >= 10 AND contains(p_name, 'ring') WHEN 2 THEN contains(p_name, 'red') END AS passed FROM part")
def _(t: Tables):
    m = F.col("p_partkey") % 4
    kind = F.when(m == 0, "refuse").when(m == 1, "contains").when(m == 2, "quote").otherwise("judge")
    return ev.graded(t.part.select(F.col("p_partkey").alias("task"), kind.alias("expectation"), F.when(F.col("p_size") >= 10, F.col("p_name")).alias("answer"), F.lit("ring").alias("needle"), F.col("p_name").alias("source"), F.lit("red").alias("quote")))


@query("x19_judge_problems", """
SELECT p_partkey AS task, unnest(list_filter([CASE WHEN p_size % 5 = 0 THEN 'marks' END, CASE WHEN p_size > 45 THEN 'citations' END, CASE WHEN p_partkey % 2 = 0 AND p_size % 3 = 0 THEN 'contradiction' END], lambda x: x IS NOT NULL)) AS problem FROM part""")
def _(t: Tables):
    s = F.col("p_size")
    return ev.judge_problems(t.part.select(F.col("p_partkey").alias("task"), F.when(s % 5 == 0, 3).otherwise(2).alias("steps"), F.array(F.lit(1), F.when(s % 3 == 0, 0).otherwise(1)).alias("marks"), s.alias("cited"), F.lit(45).alias("citations"), (F.col("p_partkey") % 2 == 0).alias("passed")))


@query("x20_task_summary", """
WITH s AS (SELECT event_type AS category, CASE WHEN event_id % 7 > 0 THEN value < 60 END AS passed, value AS ms FROM events)
SELECT category, count(*) AS tasks, count(*) FILTER (passed IS NULL) AS unrun, count(*) FILTER (passed) AS passed, round(count(*) FILTER (passed) / count(passed), 6) AS rate, quantile_disc(ms, 0.95) AS p95 FROM s GROUP BY GROUPING SETS ((category), ())""")
def _(t: Tables):
    return ev.task_summary(t.events.select(F.col("event_type").alias("category"), F.when(F.col("event_id") % 7 > 0, F.col("value") < 60).alias("passed"), F.col("value").alias("ms")))


@query("x21_dashboard", f"""WITH {PAIRS}, p AS (SELECT pairs.*, o_orderpriority AS "group" FROM pairs JOIN orders ON o_orderkey = "case"),
m AS (SELECT "group", v AS variant, 'Top' || k AS label, count(*) FILTER (has_gold AND CASE v WHEN 'before' THEN rank_before ELSE rank_after END <= k) AS numerator, count(*) FILTER (has_gold) AS denominator FROM p, (VALUES ('before'), ('after')) AS v(v), (VALUES (1), (5)) AS k(k) GROUP BY ALL)
SELECT "group", variant, label, round(numerator / nullif(denominator, 0), 6) AS value, 'ratio' AS unit, numerator, denominator FROM m
UNION ALL SELECT event_type, CASE WHEN event_id % 2 = 0 THEN 'before' ELSE 'after' END, 'p95', quantile_disc(value, 0.95), 'ms', NULL, NULL FROM events GROUP BY 1, 2""")
def _(t: Tables):
    p = pairs(t).join(t.orders.select(F.col("o_orderkey").alias("case"), F.col("o_orderpriority").alias("group")), "case").withColumn("scored", F.col("has_gold"))
    return ev.dashboard_rows(p, times(t).withColumnRenamed("arm", "variant"))


@query("x22_human_grades", """
WITH g AS (SELECT lang AS "group", source AS variant, l.doc_id // 400 AS run, quality AS good, 1 AS graded FROM labels l JOIN documents d USING (doc_id)), m AS (SELECT *, max(run) OVER (PARTITION BY "group", variant) AS newest FROM g)
SELECT "group", variant, run, sum(good)::BIGINT AS good, sum(graded)::BIGINT AS graded, round(sum(good) / sum(graded), 6) AS ratio FROM m WHERE run = newest GROUP BY ALL""")
def _(t: Tables):
    return ev.human_grades(t.labels.join(t.documents, "doc_id").select(F.col("lang").alias("group"), F.col("source").alias("variant"), F.floor(F.col("doc_id") / 400).alias("run"), F.col("quality").cast("long").alias("good"), F.lit(1).cast("long").alias("graded")))


@query("x23_metric_problems", """
SELECT event_id AS metric, unnest(list_filter([CASE WHEN user_id > 100 OR event_id % 3 = 0 THEN 'range' END, CASE WHEN user_id > 100 THEN 'denominator' END, CASE WHEN event_id % 3 = 0 THEN 'disagree' END], lambda x: x IS NOT NULL)) AS problem FROM events""")
def _(t: Tables):
    u = F.col("user_id")
    value = u / 100 + F.when(F.col("event_id") % 3 == 0, 2).otherwise(0)
    return ev.metric_problems(t.events.select(F.col("event_id").alias("metric"), F.lit("ratio").alias("unit"), value.alias("value"), u.alias("numerator"), F.lit(100).cast("long").alias("denominator")))


@query("x24_variant_summary", """
SELECT event_type AS variant, count(*) AS runs, round(avg(CASE WHEN event_id % 3 > 0 THEN user_id / 150 END), 6) AS recall, round(avg(1.0 / (user_id + 1)), 6) AS rr, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1""")
def _(t: Tables):
    return ev.variant_summary(t.events.select(F.col("event_type").alias("variant"), F.when(F.col("event_id") % 3 > 0, F.col("user_id") / 150).alias("recall"), (1 / (F.col("user_id") + 1)).alias("rr"), F.col("value").alias("ms")))


@query("x25_round_robin", "WITH k AS (SELECT p_partkey AS item, p_name AS title, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS round FROM part WHERE p_brand <> 'Brand#3') SELECT item, title, round FROM k ORDER BY round, title LIMIT 200")
def _(t: Tables):
    items = t.part.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), F.col("p_brand").alias("work"))
    return ev.round_robin(items, t.part.where("p_brand = 'Brand#3'").select(F.col("p_brand").alias("work")).distinct(), 200).select("item", "title", "round")


@query("x26_hash_sample", 'SELECT doc_id AS "case" FROM documents ORDER BY sha256(doc_id::VARCHAR) LIMIT 12')
def _(t: Tables):
    return ev.hash_sample(t.documents.select(F.col("doc_id").alias("case")), 12)


@query("x27_image_reasons", "SELECT p_partkey AS work, CASE WHEN page_id IS NULL OR page_id % 2 = 0 THEN 'no image' WHEN page_id % 3 = 0 THEN 'not allowed' WHEN page_id % 5 = 0 THEN 'file missing' ELSE 'available' END AS reason FROM part LEFT JOIN pages ON page_id = p_partkey")
def _(t: Tables):
    p = F.col("page_id")
    images = t.pages.where(p % 2 == 1).select(p.alias("work"), F.col("url").alias("path"), (p % 3 != 0).alias("allowed"), (p % 5 != 0).alias("present"))
    return ev.image_reasons(t.part.select(F.col("p_partkey").alias("work")), images)


@query("x28_calibration", "SELECT lang AS policy, count(*) AS n, round(count(*) FILTER ((n_chars > 1000)::INT = quality) / count(*), 6) AS agreement FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def _(t: Tables):
    v = t.documents.join(t.labels, "doc_id", "left").select(F.col("lang").alias("policy"), (F.col("n_chars") > 1000).cast("int").alias("verdict"), F.col("quality").alias("label"))
    return ev.calibration(v)


@query("x29_pool_losses", f"""WITH {RANKED} SELECT DISTINCT g."case", g.doc FROM g WHERE EXISTS (SELECT 1 FROM b WHERE b."case" = g."case" AND b.doc = g.doc AND arm = 'before') AND NOT EXISTS (SELECT 1 FROM b WHERE b."case" = g."case" AND b.doc = g.doc AND arm = 'before' AND rank <= 2)""")
def _(t: Tables):
    full = ranked(t).where("arm = 'before'")
    return ev.pool_losses(gold(t), full, full.where("rank <= 2"))


@query("x30_known_total", "SELECT user_id, count(*) AS calls, CASE WHEN count(*) = count(CASE WHEN value < 250 THEN event_id END) THEN sum(event_id)::BIGINT END AS total FROM events GROUP BY 1")
def _(t: Tables):
    return ev.known_total(t.events.select("user_id", F.when(F.col("value") < 250, F.col("event_id")).alias("tokens")), "user_id", "tokens")


@query("x31_ocr", """
SELECT p_partkey AS photo, p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AS transcribed, CASE WHEN p_partkey % 5 = 0 THEN 'nothing read' WHEN p_partkey % 3 <> 0 THEN 'misread' WHEN p_size < 20 THEN 'not found' ELSE 'ok' END AS stage FROM part""")
def _(t: Tables):
    p = F.col("p_partkey")
    text = F.when(p % 5 == 0, " ").when(p % 3 == 0, F.concat(F.lit("LABEL\n"), F.lower(F.regexp_replace("p_brand", "#", "-")))).otherwise("Brand 999")
    return ev.ocr_outcome(t.part.select(p.alias("photo"), text.alias("text"), F.regexp_replace("p_brand", "#", " ").alias("expected"), (F.col("p_size") >= 20).alias("found")))


@query("x32_photo_passes", """
WITH r AS (SELECT user_id AS "case", CASE WHEN event_id % 4 = 0 THEN event_type = 'error' ELSE event_type <> 'error' OR user_id % 2 = 0 END AS passed FROM events)
SELECT "case", bool_and(passed) AS comparable, count(*) FILTER (NOT passed) AS failures FROM r GROUP BY 1""")
def _(t: Tables):
    u, e = F.col("user_id"), F.col("event_id")
    is_error = F.col("event_type") == "error"
    expected = F.when(e % 4 != 0, F.array(u))
    candidates = F.when(e % 4 == 0, F.when(~is_error, F.array(u))).otherwise(F.when(is_error & (u % 2 != 0), F.array(u, u)).otherwise(F.array(u)))
    return ev.photo_passes(t.events.select(u.alias("case"), F.col("event_type").alias("arm"), candidates.cast("array<bigint>").alias("candidates"), expected.cast("array<bigint>").alias("expected")))


@query("x33_variant_recall", f"""WITH {RANKED} SELECT arm AS variant, count(*) AS cases, round(avg(coalesce(rank <= 5, false)::INT), 6) AS recall5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM ranks WHERE n_gold IS NOT NULL AND "case" % 5 <> 0 GROUP BY 1""")
def _(t: Tables):
    return ev.variant_recall(ranks(t).withColumn("followup", F.col("case") % 5 == 0).withColumnRenamed("arm", "variant"))


@query("x34_reused", "SELECT md5(text) AS key, length(text) AS result, bool_or(source = 'src1') OVER (PARTITION BY text) AS reused FROM documents")
def _(t: Tables):
    d = t.documents.select(F.md5("text").alias("key"), "text")
    stored = t.documents.where("source = 'src1'").select(F.md5("text").alias("key"), F.length("text").alias("result")).distinct()
    return ev.reused(d, stored, lambda new: new.select("key", F.length("text").alias("result")))
