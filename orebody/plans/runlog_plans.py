"""Run logs (R) and memory (M): events, orders and conversations stand for runs, reviews and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import to_instant
from ..operators import memory as m
from ..operators import runlog as r
from .registry import Tables, query

STATUS = "CASE event_type WHEN 'error' THEN 'timeout' WHEN 'view' THEN 'insufficient_evidence' WHEN 'click' THEN 'not_matched' WHEN 'signup' THEN 'verification_failed' ELSE 'ok' END"
STAGE = "CASE event_type WHEN 'error' THEN 'service' WHEN 'signup' THEN 'verification' WHEN 'click' THEN CASE WHEN user_id % 2 = 0 THEN 'vision' END WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'generation' ELSE 'retrieval' END END"


def runs(t: Tables):
    status = F.when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "view", "insufficient_evidence").when(F.col("event_type") == "click", "not_matched").when(F.col("event_type") == "signup", "verification_failed").otherwise("ok")
    retrieved = F.when(F.col("event_id") % 3 == 0, F.array("event_id")).when(F.col("event_id") % 3 == 1, F.array().cast("array<bigint>"))
    return t.events.select(F.col("event_id").alias("id"), status.alias("status"), retrieved.alias("retrieved"), (F.col("user_id") % 2 == 0).alias("photo"), F.col("ts").alias("created_at"), "user_id")


@query("r1_failure_stage", f"SELECT event_id AS id, {STAGE} AS stage FROM events")
def _(t: Tables):
    return runs(t).select("id", r.failure_stage(F.col("status"), F.col("retrieved"), F.col("photo")).alias("stage"))


@query("r2_defaults", f"SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 'unknown' ELSE {STATUS} END AS status, {STAGE} AS failure_stage, 'pending' AS review FROM events")
def _(t: Tables):
    rows = runs(t).withColumn("status", F.when(F.col("status") != "ok", F.col("status"))).withColumn("failure_stage", F.lit(None).cast("string")).withColumn("review", F.lit(None).cast("string"))
    return r.with_defaults(rows).select("id", "status", "failure_stage", "review")


@query("r3_review_page", """
WITH f AS (SELECT event_id // 2 AS id, count(*) AS notes FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT e.event_id AS id, e.ts AS created_at, coalesce(notes, 0) AS notes FROM events e LEFT JOIN f ON f.id = event_id WHERE event_type IN ('view', 'error') AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 100""")
def _(t: Tables):
    log = lambda kind: t.events.where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    notes = t.events.where("event_type = 'click'").select(F.floor(F.col("event_id") / 2).alias("id"))
    import datetime

    return r.review_page(log("view"), log("error"), notes, (datetime.datetime(2024, 1, 20), 0), 100)


@query("r4_recovered", """
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'interrupted' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, 'interrupted' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderpriority = '1-URGENT'""")
def _(t: Tables):
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "running").otherwise(F.col("o_orderstatus")).alias("status"), "o_orderpriority")
    return r.recovered(o.where("id % 3 > 0"), o.where("o_orderpriority = '1-URGENT'").select("id"))


@query("r5_idempotent", """
WITH q AS (SELECT event_id AS id, user_id AS session, event_id % 40 AS request, event_type AS fingerprint FROM events), f AS (SELECT session, request, min(id) AS first, arg_min(fingerprint, id) AS f FROM q GROUP BY ALL)
SELECT id, session, request, first, CASE WHEN id = first THEN 'run' WHEN fingerprint = f THEN 'replay' ELSE 'conflict' END AS outcome FROM q JOIN f USING (session, request)""")
def _(t: Tables):
    return r.idempotent(t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("session"), (F.col("event_id") % 40).alias("request"), F.col("event_type").alias("fingerprint")))


@query("r6_interactions", """
WITH a AS (SELECT user_id AS session, event_id AS id, event_type AS action, event_id % 2 AS item FROM events WHERE event_type <> 'error' OR event_id % 2 = 0),
w AS (SELECT *, lag((action, item)) OVER (PARTITION BY session ORDER BY id) AS was FROM a), k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY id DESC) AS k FROM w WHERE was IS NULL OR was <> (action, item))
SELECT session, id, action, item FROM k WHERE k <= 20""")
def _(t: Tables):
    zero, both = F.array(F.lit(0).cast("long")), F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))
    return r.interactions(t.events.select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), F.col("event_type").alias("action"), (F.col("event_id") % 2).alias("item"), F.when(F.col("event_type") == "error", zero).otherwise(both).alias("allowed_items")))


@query("r7_retakes", """
WITH RECURSIVE p AS (SELECT event_id AS id, CASE WHEN event_id % 16 > 0 THEN event_id - 1 END AS parent, CASE WHEN event_type = 'error' THEN 'service' ELSE 'ok' END AS status FROM events),
up(id, above, n) AS (SELECT id, parent, 0 FROM p UNION ALL SELECT up.id, p.parent, up.n + CASE WHEN p.status = 'service' THEN 0 ELSE 1 END FROM up JOIN p ON p.id = up.above)
SELECT id, max(n)::BIGINT AS retakes, max(n) <= 1 AS allowed FROM up GROUP BY id""")
def _(t: Tables):
    return r.retakes(t.events.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 16 > 0, F.col("event_id") - 1).alias("parent"), F.when(F.col("event_type") == "error", "service").otherwise("ok").alias("status")))


@query("r8_reviewed", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 4 > 0 THEN 'fixed' ELSE o_orderstatus END AS status, o_orderpriority AS stage, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 4 = 0 THEN 'unknown regression run' END AS problem FROM orders""")
def _(t: Tables):
    o = F.col("o_orderkey")
    base = t.orders.select(o.alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("stage"))
    rv = t.orders.where(o % 5 == 0).select(o.alias("id"), F.lit("fixed").alias("new_status"), F.lit(None).cast("string").alias("new_stage"), F.when(o % 4 == 0, -1).otherwise(o % 7).alias("regression"))
    return r.reviewed(base, rv, t.orders.where("o_orderkey < 7").select(o.alias("id")))


#: The blocks of an HMAC under the key "pepper", in hex.
INNER, OUTER = (bytes(x ^ pad for x in b"pepper".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))


@query("r9_anonymous", f"""
WITH i AS (SELECT event_id, event_type, sha256(unhex('{INNER}') || encode(user_id::VARCHAR)) AS h FROM events)
SELECT event_id, substr(sha256(unhex('{OUTER}') || unhex(h)), 1, 24) AS user_id, event_type FROM i""")
def _(t: Tables):
    return r.anonymous(t.events, ("user_id",), "pepper", ("event_id", "user_id", "event_type"))


@query("r10_phase_times", "SELECT user_id AS run, round(coalesce(sum(value) FILTER (event_type = 'view'), 0), 6) AS view_ms, count(*) FILTER (event_type = 'view') AS view_calls, round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 6) AS click_ms, count(*) FILTER (event_type = 'click') AS click_calls FROM events GROUP BY 1")
def _(t: Tables):
    return r.phase_times(t.events.select(F.col("user_id").alias("run"), F.col("event_type").alias("phase"), F.col("value").alias("ms")), ("view", "click"))


@query("r11_costs", "SELECT event_type AS model, sum(user_id)::BIGINT AS hit, sum(event_id)::BIGINT AS miss, count(*) AS out, CASE event_type WHEN 'view' THEN round((sum(user_id) * 0.1 + sum(event_id) * 0.5 + count(*) * 2) / 1e6, 9) WHEN 'click' THEN round((sum(user_id) * 1.0 + sum(event_id) * 2 + count(*) * 3) / 1e6, 9) END AS cost FROM events GROUP BY 1")
def _(t: Tables):
    return r.costs(t.events.select(F.col("event_type").alias("model"), F.col("user_id").alias("hit"), F.col("event_id").alias("miss"), F.lit(1).alias("out")), {"view": (0.1, 0.5, 2.0), "click": (1.0, 2.0, 3.0)})


@query("r12_histogram", "SELECT event_type, CASE WHEN value < 0 THEN 0 WHEN value >= 200 THEN 11 ELSE floor(value / 20) + 1 END::BIGINT AS bucket, count(*) AS n FROM events GROUP BY ALL")
def _(t: Tables):
    return r.histogram(t.events, "event_type", "value", 0.0, 200.0, 10)


@query("r13_feedback", """
SELECT event_id AS id, event_type AS signal, CASE event_type WHEN 'click' THEN 'explicit' WHEN 'view' THEN 'implicit' ELSE 'auto' END AS kind, CASE WHEN user_id % 2 = 0 THEN 'consumed' ELSE 'pending' END AS status FROM events WHERE event_type IN ('click', 'view', 'error')""")
def _(t: Tables):
    part = lambda kind: t.events.where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), F.col("event_type").alias("signal"), (F.col("user_id") % 2 == 0).alias("consumed"))
    return r.feedback_union(part("click"), part("view"), part("error"))


def signals(t: Tables):
    s = F.when(F.col("event_type") == "purchase", "up").when(F.col("event_type") == "error", "down").otherwise(F.col("event_type"))
    return t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("dept"), s.alias("signal"))


@query("r14_adoption", "SELECT user_id AS dept, round(count(*) FILTER (event_type = 'purchase') / greatest(count(*) FILTER (event_type IN ('purchase', 'error')), 1), 6) AS rate FROM events GROUP BY 1")
def _(t: Tables):
    return r.adoption(signals(t), "dept")


def messages(t: Tables):
    return t.conversations.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", "text")


@query("r15_follow_ups", "SELECT conv_id AS session, turn AS seq FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM conversations) WHERE role = 'user' AND was = 'assistant'")
def _(t: Tables):
    return r.follow_ups(messages(t))


@query("r16_auto_signal", "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'verify_fail' WHEN user_id / 150 < 0.6 THEN 'low_confidence' END AS signal FROM events")
def _(t: Tables):
    return t.events.select(F.col("event_id").alias("id"), r.auto_signal(F.col("event_type") != "error", F.col("user_id") / 150).alias("signal"))


@query("r17_bad_cases", "SELECT CASE event_type WHEN 'error' THEN 'down' ELSE event_type END AS signal, count(*) AS n, 'answer' AS cause FROM events WHERE event_type IN ('error', 'view') GROUP BY 1")
def _(t: Tables):
    return r.bad_cases(signals(t), ("down", "view"))


@query("r18_rules", "SELECT id, dept, substr(text, 1, 20) AS title FROM (SELECT text, min(doc_id) AS id, arg_min(source, doc_id) AS dept FROM documents GROUP BY text) ORDER BY id LIMIT 50")
def _(t: Tables):
    return r.rule_suggestions(t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("dept"), "text")).drop("text")


@query("r19_rubric", "SELECT p_partkey AS id, list_sort(list_distinct([p_brand, p_type, p_type, 'x'])) AS rubric FROM part")
def _(t: Tables):
    return t.part.select(F.col("p_partkey").alias("id"), F.array_sort(r.appended_rubric(F.array("p_brand", "p_type"), F.array(F.col("p_type"), F.lit("x")))).alias("rubric"))


@query("r20_cycle_report", "SELECT event_type AS kind, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS before, count(*) AS after, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS diff FROM events GROUP BY 1")
def _(t: Tables):
    e = t.events.withColumnRenamed("event_type", "kind")
    return r.cycle_report(e.where("ts < timestamp '2024-01-15'"), e)


@query("r21_skill_versions", "SELECT p_partkey AS id, p_name AS name, row_number() OVER w AS version, lag(p_partkey) OVER w AS replaces FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_partkey)")
def _(t: Tables):
    return r.skill_versions(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


ARM = "CASE WHEN ('0x' || substr(sha256(user_id || ':' || event_id || ':skill:1'), 1, 8))::BIGINT / 4294967295.0 < 0.3 THEN 'treatment' ELSE 'control' END"


def arms(t: Tables):
    arm = r.experiment_arm(F.lit(30.0), F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.lit("skill"), F.lit("1"))
    return t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("experiment"), arm.alias("arm"), F.when(F.col("event_id") % 5 > 0, F.col("value") < 60).alias("success"), F.col("event_type").alias("skill"), F.col("ts").alias("at"))


@query("r22_arms", f"SELECT event_id AS id, {ARM} AS arm FROM events")
def _(t: Tables):
    return arms(t).select("id", "arm")


@query("r23_outcomes", "WITH x AS (SELECT unnest([event_id, event_id + 1]) AS id, value > 50 AS success, event_id AS \"at\" FROM events WHERE event_type = 'click') SELECT event_id AS id, s AS success FROM events LEFT JOIN (SELECT id, arg_max(success, \"at\") AS s FROM x GROUP BY id) x ON x.id = event_id")
def _(t: Tables):
    out = t.events.where("event_type = 'click'").select(F.array("event_id", F.col("event_id") + 1).alias("execution_ids"), (F.col("value") > 50).alias("success"), F.col("event_id").alias("at"))
    return r.with_outcomes(t.events.select(F.col("event_id").alias("id")), out)


@query("r24_read_out", f"""WITH a AS (SELECT event_type AS experiment, {ARM} AS arm, CASE WHEN event_id % 5 > 0 THEN value < 60 END AS success FROM events),
g AS (SELECT experiment, count(success) FILTER (arm = 'treatment') AS n_t, count(success) FILTER (arm = 'control') AS n_c, round(avg(success::INT) FILTER (arm = 'treatment'), 6) AS treatment, round(avg(success::INT) FILTER (arm = 'control'), 6) AS control FROM a GROUP BY 1)
SELECT *, n_t >= 10 AND n_c >= 10 AND treatment + 0.1 < control AS rollback FROM g""")
def _(t: Tables):
    return r.read_out(arms(t))


@query("r25_replay", "SELECT lang, count(*) AS n, round(avg(quality), 6) AS baseline, round(avg(toxic), 6) AS candidate, round(round(avg(toxic), 6) - round(avg(quality), 6), 6) AS delta, round(avg(toxic), 6) >= round(avg(quality), 6) AS passed FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def _(t: Tables):
    return r.replay_summary(t.labels.join(t.documents, "doc_id").select("lang", F.col("quality").alias("baseline"), F.col("toxic").alias("candidate")), "lang")


@query("r26_skill_usage", "SELECT event_type AS skill, count(*) AS triggers, count(*) FILTER (event_id % 5 > 0 AND value < 60) AS successes, round(avg(CASE WHEN event_id % 5 > 0 THEN (value < 60)::INT END), 6) AS rate, max(ts) AS last FROM events GROUP BY 1")
def _(t: Tables):
    return r.skill_usage(arms(t))


@query("r27_lifecycle", """
WITH s AS (SELECT o_custkey AS skill, count(*) AS triggers, avg((o_orderstatus = 'F')::INT) AS rate, min(o_orderdate) AS c FROM orders GROUP BY 1),
f AS (SELECT skill, CASE WHEN triggers < 5 AND c < TIMESTAMP '1998-01-01' THEN 'rare' WHEN triggers >= 20 AND rate < 0.6 THEN 'poor' ELSE 'active' END AS fate FROM s)
SELECT skill, fate, CASE WHEN fate = 'active' THEN 'active' ELSE 'stale' END AS status, fate = 'poor' AND skill % 2 = 1 AS propose_split FROM f""")
def _(t: Tables):
    s = t.orders.groupBy(F.col("o_custkey").alias("skill")).agg(F.count("*").alias("triggers"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("rate"), F.min("o_orderdate").alias("created_at"))
    return r.lifecycle(s, s.where("skill % 2 = 0").select("skill"), F.lit("1998-01-15").cast("timestamp"))


@query("r28_deployed", """
WITH i AS (SELECT p_partkey AS id, p_size / 50 AS confidence, CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 1 END AS replaces, CASE WHEN p_partkey % 2 = 0 THEN 'pending' ELSE 'active' END AS status FROM part)
SELECT i.id, CASE WHEN i.status = 'pending' AND i.confidence >= 0.7 THEN 'active' WHEN i.status = 'active' AND p.confidence >= 0.7 THEN 'deprecated' ELSE i.status END AS status FROM i LEFT JOIN i p ON p.replaces = i.id""")
def _(t: Tables):
    p = F.col("p_partkey")
    return r.deployed(t.part.select(p.alias("id"), (F.col("p_size") / 50).alias("confidence"), F.when(p % 2 == 0, p + 1).alias("replaces"), F.when(p % 2 == 0, "pending").otherwise("active").alias("status")), "human_on_loop", 0.7)


@query("r29_review_orders", """
WITH v AS (SELECT l_orderkey AS "order", 5 AS n, l_linenumber - 1 AS i, l_returnflag = 'R' AS ok FROM lineitem),
g AS (SELECT "order", list_sort(list_distinct(list(i))) AS seen, sum(CASE WHEN i < 5 THEN ok::INT END) AS good FROM v GROUP BY 1)
SELECT "order", list_filter([0, 1, 2, 3, 4], lambda x: NOT list_contains(seen, x)) AS missing, list_filter(seen, lambda x: x > 4) AS extra, list_filter(seen, lambda x: x < 5) = [0, 1, 2, 3, 4] AND len(seen) = 5 AS complete, round(good / 5, 6) AS accuracy FROM g""")
def _(t: Tables):
    return r.review_orders(t.lineitem.select(F.col("l_orderkey").alias("order"), F.lit(5).alias("n"), (F.col("l_linenumber") - 1).alias("index"), (F.col("l_returnflag") == "R").alias("correct")))


@query("r30_phases", """
WITH v AS (SELECT user_id AS dept, event_id AS "at", 1 AS total, (event_type <> 'error')::INT AS correct FROM events),
c AS (SELECT dept, "at", sum(total) OVER w AS n, round(sum(correct) OVER w / sum(total) OVER w, 4) AS accuracy FROM v WINDOW w AS (PARTITION BY dept ORDER BY "at")),
p AS (SELECT *, CASE WHEN accuracy >= 0.8 AND n >= 5 THEN 'human_out_of_loop' WHEN accuracy >= 0.8 THEN 'human_on_loop' ELSE 'human_in_loop' END AS phase FROM c)
SELECT dept, "at", n::BIGINT AS n, accuracy, phase, phase <> coalesce(lag(phase) OVER (PARTITION BY dept ORDER BY "at"), 'human_in_loop') AS changed FROM p""")
def _(t: Tables):
    return r.phases(t.events.select(F.col("user_id").alias("dept"), F.col("event_id").alias("at"), F.lit(1).alias("total"), (F.col("event_type") != "error").cast("int").alias("correct")))


@query("r31_exit_samples", "SELECT source AS dept, count(*) AS sampled, bool_or(doc_id % 50 = 0) AS demote FROM documents WHERE ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0 < 0.25 GROUP BY 1")
def _(t: Tables):
    return r.exit_samples(t.documents.select(F.col("doc_id").alias("doc"), F.col("source").alias("dept"), (F.col("doc_id") % 50 == 0).alias("error")), 25.0)


@query("r32_questions", "WITH c AS (SELECT doc_id AS doc, source, unnest(range(0, len(string_split(text, chr(10))))) AS chunk FROM documents) SELECT doc, chunk::INT AS chunk, source || ': what does part ' || (chunk + 1) || ' say?' AS question FROM c WHERE chunk < 3")
def _(t: Tables):
    return r.questions(t.documents.select(F.col("doc_id").alias("doc"), F.col("source").alias("title"), F.posexplode(F.split("text", "\n")).alias("chunk", "text")))


@query("r33_board", """
WITH n AS (SELECT n_name AS dept, n_nationkey AS k FROM nation)
SELECT dept, (SELECT count(*) FROM customer WHERE c_nationkey = k) AS docs, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = k) AS chunks,
 (SELECT count(*) FROM supplier WHERE s_nationkey = k AND s_suppkey % 4 > 0) + (SELECT count(*) FROM supplier WHERE s_suppkey % 4 = 0) AS skills, (SELECT count(*) FROM part WHERE p_size % 25 = k OR p_partkey % 25 = k) AS conflicts FROM n""")
def _(t: Tables):
    nat = t.nation.select(F.col("n_name").alias("dept"), F.col("n_nationkey").alias("k"))
    named = lambda df, key: df.join(nat, key == F.col("k"))
    skills = named(t.supplier, F.col("s_nationkey")).select(F.when(F.col("s_suppkey") % 4 > 0, F.col("dept")).alias("dept"))
    conf = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 25).alias("a"), (F.col("p_partkey") % 25).alias("b"))
    conf = conf.join(nat.select(F.col("k").alias("a"), F.col("dept").alias("src")), "a").join(nat.select(F.col("k").alias("b"), F.col("dept").alias("dst")), "b").select("id", "src", "dst")
    docs = named(t.customer, F.col("c_nationkey")).select("dept", "c_custkey")
    return r.department_board(nat.select("dept"), docs, docs.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).select("dept"), skills, conf)


@query("r34_insights", "SELECT count(DISTINCT user_id) AS sessions, count(*) AS runs, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error, 0::BIGINT AS unheard FROM events")
def _(t: Tables):
    return r.insights(t.events.select(F.col("user_id").alias("session"), F.col("event_type").alias("signal")), ("view", "error", "unheard"))


@query("m1_instants", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN date_trunc('second', ts) END AS at FROM events")
def _(t: Tables):
    e = F.col("event_id") % 3
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(e == 0, F.concat(iso, F.lit("Z"))).when(e == 1, iso).otherwise("no date")
    return t.events.select("event_id", to_instant(raw).alias("at"))


@query("m2_sequence", "SELECT event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def _(t: Tables):
    return m.sequence_numbers(t.events.select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("id"))).select("id", "seq")


@query("m3_replay", "SELECT conv_id AS session, md5(string_agg(text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def _(t: Tables):
    return m.replay(messages(t)).select("session", F.md5(F.array_join("texts", "|")).alias("digest"))


@query("m4_summary", "SELECT conv_id AS session, turn AS seq, md5(string_agg(role || ': ' || substr(text, 1, 240), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS 3 PRECEDING)) AS digest FROM conversations")
def _(t: Tables):
    return m.rolling_summary(messages(t)).select("session", "seq", F.md5("summary").alias("digest"))


@query("m5_facts", """
WITH f AS (SELECT event_id AS id, user_id AS owner, event_type AS key, ts, CASE WHEN event_type = 'error' THEN 'rejected' WHEN event_id % 3 = 0 AND event_id % 2 = 1 THEN 'candidate' ELSE 'fact' END AS kind FROM events),
k AS (SELECT *, row_number() OVER w AS n, lead(id) OVER w AS nx FROM f WINDOW w AS (PARTITION BY owner, key, kind ORDER BY ts, id))
SELECT id, owner, key, CASE WHEN kind <> 'fact' THEN kind WHEN nx IS NULL THEN 'active' ELSE 'superseded' END AS status, CASE WHEN kind = 'fact' THEN n END AS revision, CASE WHEN kind = 'fact' THEN nx END AS superseded_by, ts + INTERVAL 180 DAY AS expires_at FROM k""")
def _(t: Tables):
    e = F.col("event_id")
    value = F.when(F.col("event_type") == "error", "my bank_account").otherwise("x")
    return m.revised_facts(t.events.select(e.alias("id"), F.col("user_id").alias("owner"), F.col("event_type").alias("key"), value.alias("value"), "ts", (e % 3 == 0).alias("inferred"), (e % 2 == 0).alias("consent")))


@query("m6_recall", """
WITH f AS (SELECT o_orderkey AS fact, o_custkey AS owner, o_orderstatus AS key, round(CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.8 ELSE 0.0 END * (o_orderkey % 10) / 10, 6) AS weight, o_orderdate AS "at" FROM orders),
j AS (SELECT c_custkey AS query, fact, contains(lower(c_name || ' ' || c_mktsegment), lower(key))::INT AS named, weight, "at" FROM customer JOIN f ON owner = c_custkey)
SELECT query, fact, named, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY named DESC, weight DESC, "at" DESC, fact) AS rank FROM j) WHERE rank <= 8""")
def _(t: Tables):
    f = t.orders.select(F.col("o_orderkey").alias("fact"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("key"), F.col("o_orderpriority").alias("authority"), (F.col("o_orderkey") % 10 / 10).alias("confidence"), F.col("o_orderdate").alias("confirmed_at"))
    q = t.customer.select(F.col("c_custkey").alias("query"), F.col("c_custkey").alias("owner"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"))
    return m.recall(f, q, {"1-URGENT": 1.0, "2-HIGH": 0.8})


@query("m7_forget", "SELECT c_custkey AS owner, 'F' AS key, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS removed FROM customer WHERE c_custkey % 10 = 0")
def _(t: Tables):
    f = t.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("key"), F.col("o_orderkey").alias("id"))
    return m.forget(f, t.customer.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("owner"), F.lit("F").alias("key")))[1]


@query("m8_publish", "SELECT p_partkey AS fact, p_partkey % 3 = 0 AND p_partkey % 2 = 1 AS published FROM part")
def _(t: Tables):
    p = F.col("p_partkey")
    docs = t.part.select(p.alias("doc"), F.col("p_brand").alias("dept"), F.lit("1.0").alias("version"), F.when(p % 2 == 1, "active").otherwise("archived").alias("status"))
    facts = t.part.select(p.alias("fact"), F.when(p % 3 == 0, F.col("p_brand")).otherwise("other").alias("dept"), F.lit("1.0").alias("version"), p.alias("chunk"))
    return m.valid_sources(facts, docs, t.part.select(p.alias("chunk"), p.alias("doc"))).select("fact", (F.col("n_valid") > 0).alias("published"))


@query("m9_org_recall", """
WITH f AS (SELECT doc_id AS fact, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.4 END AS a, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents),
q AS (SELECT item_id AS query, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark), e AS (SELECT query, len(w) AS n, unnest(w) AS term FROM q),
s AS (SELECT query, fact, round(count(*) / n * a, 6) AS score FROM e JOIN f USING (term) GROUP BY query, fact, n, a)
SELECT query, fact, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, fact) AS rank FROM s) WHERE rank <= 8""")
def _(t: Tables):
    f = t.documents.select(F.col("doc_id").alias("fact"), F.when(F.col("doc_id") % 2 == 0, "official").otherwise("inferred").alias("authority"), "text")
    return m.org_recall(f, t.benchmark.select(F.col("item_id").alias("query"), "text"), {"official": 1.0, "inferred": 0.4})


@query("m10_usage", "SELECT l_partkey AS chunk, count(*) AS uses FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(t: Tables):
    facts = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("chunks"))
    used = facts.select(F.explode("chunks").alias("chunk"))
    return used.join(t.part.select(F.col("p_partkey").alias("chunk")), "chunk", "left_semi").groupBy("chunk").agg(F.count("*").alias("uses"))


@query("m11_invalidated", "SELECT l_orderkey AS fact, bool_or(l_partkey % 10 = 0) AS stale FROM lineitem GROUP BY 1")
def _(t: Tables):
    facts = t.lineitem.groupBy(F.col("l_orderkey").alias("fact")).agg(F.collect_set("l_partkey").alias("docs"))
    return m.invalidated(facts, t.part.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("doc"))).select("fact", "stale")


@query("m12_budget", """
SELECT session, seq, used <= 1500 AS kept FROM (SELECT conv_id AS session, turn AS seq, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 ELSE 1 END, -turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations)""")
def _(t: Tables):
    items = messages(t).select(F.col("session").alias("request"), F.col("seq").alias("item"), F.when(F.col("role") == "system", 0).otherwise(1).alias("kind_rank"), (-F.col("seq")).alias("age"), (F.length("text") + 1).alias("size"))
    return m.within_budget(items, 1500).select(F.col("request").alias("session"), F.col("item").alias("seq"), "kept")


@query("m13_pruned", "SELECT 'events' AS name, count(*) FILTER (ts + INTERVAL 10 DAY <= TIMESTAMP '2024-01-20') AS removed FROM events UNION ALL SELECT 'orders', count(*) FILTER (o_orderdate <= DATE '1996-01-01') FROM orders")
def _(t: Tables):
    one = m.pruned(t.events.withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 10 DAYS")), "events", F.lit("2024-01-20").cast("timestamp"))[1]
    return one.unionByName(m.pruned(t.orders.withColumn("expires_at", F.col("o_orderdate")), "orders", F.lit("1996-01-01").cast("timestamp"))[1])


@query("m14_cascade", """
SELECT user_id AS "user", 'events' AS name, count(*) AS removed FROM events WHERE user_id % 50 = 0 GROUP BY 1 UNION ALL SELECT o_custkey, 'orders', count(*) FROM orders WHERE o_custkey % 50 = 0 GROUP BY 1""")
def _(t: Tables):
    users = t.customer.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("user"))
    return m.cascade({"events": t.events.withColumnRenamed("user_id", "user"), "orders": t.orders.withColumnRenamed("o_custkey", "user")}, users)[1]


@query("m15_hot_topics", """
WITH e AS (SELECT source AS dept, DATE '2024-01-01' + (doc_id % 3)::INT AS day, coalesce(list_filter(regexp_extract_all(lower(text), '[一-鿿]|[a-z0-9]+'), lambda w: length(w) > 1)[1], 'other') AS topic FROM documents),
n AS (SELECT dept, day, topic, count(*) AS n FROM e GROUP BY ALL) SELECT dept, day, topic, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY dept, day ORDER BY n DESC, topic) AS rank FROM n) WHERE rank <= 5""")
def _(t: Tables):
    ts = F.to_timestamp(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 3).cast("int")))
    return m.hot_topics(t.documents.select(F.col("source").alias("dept"), ts.alias("ts"), "text"))


@query("m16_profiles", "SELECT user_id AS \"user\", sum(n)::BIGINT AS queries, list(event_type || '=' || n ORDER BY event_type) AS kinds FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def _(t: Tables):
    p = m.profiles(t.events.select(F.col("user_id").alias("user"), F.col("event_type").alias("kind")))
    return p.select("user", "queries", F.transform(F.array_sort(F.map_entries("kinds")), lambda x: F.concat_ws("=", x["key"], x["value"])).alias("kinds"))


@query("m17_migrated", """
WITH l AS (SELECT c_custkey AS owner, unnest(['segment', 'nation']) AS key, unnest([c_mktsegment, c_nationkey::VARCHAR]) AS value FROM customer)
SELECT owner, key, value, CASE WHEN owner % 2 = 0 THEN 'active' ELSE 'candidate' END AS status FROM l WHERE NOT (key = 'nation' AND owner % 3 = 0)""")
def _(t: Tables):
    c = F.col("c_custkey")
    legacy = t.customer.select(c.alias("owner"), F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("facts"), F.when(c % 2 == 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>")).alias("sources"))
    return m.migrated(legacy, t.customer.where(c % 3 == 0).select(c.alias("owner"), F.lit("nation").alias("key")))
