"""Streaming (W): the jobs run over the files of a table until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import new_path
from ..sources.catalogue import text_blocks
from ..streaming import jobs
from .registry import Tables, query


def stream(t: Tables, name: str):
    rows = jobs.table_stream(t.spark, f"{t.folder}/{name}.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


@query("w1_daily_topics", """
WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type AS topic, count(*) AS n FROM events GROUP BY 1, 2)
SELECT day, topic, n FROM d WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(t: Tables):
    return jobs.drained(jobs.daily_topics(stream(t, "events").select("ts", F.col("event_type").alias("topic")))).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("w2_sessions", """
WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g)
SELECT user_id AS "user", min(ts) AS start, count(*) AS n, list(event_id ORDER BY ts, event_id)[-10:] AS last FROM i GROUP BY user_id, island HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(t: Tables):
    found = jobs.drained(jobs.session_contexts(stream(t, "events").select("ts", F.col("user_id").alias("user"), F.col("event_id").alias("id"))))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("w3_unexpired", "SELECT event_id FROM events WHERE ts + INTERVAL 2 DAY > TIMESTAMP '2024-01-20'")
def _(t: Tables):
    rows = t.events.select("event_id", (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("expires_at"))
    return jobs.unexpired(rows, F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query("w3_expired", """
SELECT user_id AS session, max(ts) + INTERVAL 12 HOUR AS expires_at, count(*) AS writes FROM events
GROUP BY 1 HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(t: Tables):
    writes = stream(t, "events").select(F.col("user_id").alias("session"), "ts", (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("expires_at"))
    with jobs.rocks_state(t.spark):
        return jobs.drained(jobs.expired(writes)).withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))


#: Every tenth event comes with the last of four arrivals, the others with their week's.
ARRIVAL = "CASE WHEN event_id % 10 = 3 THEN 3 ELSE least((day(ts) - 1) // 8, 3) END"


@query("w1_kept_and_late", f"""
WITH e AS (SELECT event_id, ts, {ARRIVAL} AS a FROM events),
m AS (SELECT a, max(max(ts)) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS mark FROM e GROUP BY a)
SELECT event_id, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= mark, false) AS late FROM e JOIN m USING (a)""")
def _(t: Tables):
    source, root = new_path(t.spark, "arrivals"), new_path(t.spark, "kept_and_late")
    week = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3)).cast("int")
    rows = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 10 == 3, 3).otherwise(week).alias("arrival"))
    for k in range(4):
        rows.where(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(source)
        came = t.spark.readStream.schema("event_id long, ts timestamp").parquet(source)
        kept, late = jobs.kept_and_late(came, F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY"), root)
    return kept.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))


@query("w4_deduplicated", "SELECT DISTINCT user_id, event_type FROM events")
def _(t: Tables):
    return jobs.drained(jobs.deduplicated(stream(t, "events").select("ts", "user_id", "event_type"), ["user_id", "event_type"])).select("user_id", "event_type")


@query("w5_failure_streaks", """
WITH e AS (SELECT user_id AS client, event_id AS id, ts, event_type = 'purchase' AS ok FROM events), p AS (SELECT *, sum(ok::INT) OVER (PARTITION BY client ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS epoch FROM e)
SELECT client, id, sum((NOT ok)::INT) OVER w::BIGINT AS recent, sum((NOT ok)::INT) OVER w >= 2 AS blocked FROM p WINDOW w AS (PARTITION BY client, epoch ORDER BY ts RANGE BETWEEN INTERVAL 7200 SECOND PRECEDING AND CURRENT ROW)""")
def _(t: Tables):
    log = t.events.select(F.col("user_id").alias("client"), F.col("event_id").alias("id"), "ts", (F.col("event_type") == "purchase").alias("ok"))
    return jobs.failure_streaks(log, 7200, 2)


@query("w6_usage", """
WITH m AS (SELECT user_id AS client, date_trunc('minute', ts) AS m, count(*) AS n FROM events GROUP BY ALL), d AS (SELECT client, m::DATE AS day, sum(n)::BIGINT AS requests, max(n) AS busiest FROM m GROUP BY ALL),
a AS (SELECT day, sum(requests)::BIGINT AS day_total FROM d GROUP BY 1), l AS (SELECT *, sum(day_total) OVER (ORDER BY day)::BIGINT AS lifetime FROM a)
SELECT client, day, requests, busiest, day_total, lifetime, busiest > 3 AS over_minute, requests > 20 AS over_day, day_total > 100 AS over_total_day, lifetime > 1000 AS over_lifetime FROM d JOIN l USING (day)""")
def _(t: Tables):
    return jobs.usage_report(t.events.select(F.col("user_id").alias("client"), "ts"))


@query("w7_opened", "SELECT user_id % 5 AS address, date_trunc('minute', ts) AS minute, count(*) AS n, count(*) > 1 AS over FROM events GROUP BY 1, 2")
def _(t: Tables):
    return jobs.opened_sessions(t.events.select((F.col("user_id") % 5).alias("address"), "ts"), 1)


@query("w8_cycle", "SELECT event_type AS signal, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables):
    per = jobs.cycles(stream(t, "events"), lambda batch, _: batch.groupBy(F.col("event_type").alias("signal")).agg(F.count("*").alias("n")), "signal string, n long")
    return per.groupBy("signal").agg(F.sum("n").alias("n"))


@query("w9_ingest", r"SELECT doc_id, count(*) AS blocks FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE regexp_replace(x, '^\s+|\s+$', '', 'g') <> '' GROUP BY doc_id")
def _(t: Tables):
    blocks = jobs.drained(text_blocks(stream(t, "documents").select("doc_id", "text")))
    return blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"))


@query("w10_numbered", "SELECT user_id AS session, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def _(t: Tables):
    messages = stream(t, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), "ts")
    return jobs.numbered_on(messages, new_path(t.spark, "numbered"))
