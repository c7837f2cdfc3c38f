"""Structured Streaming jobs, and audits of the same logs as batch windows.

Each job is a function from a stream to a stream; ``drained`` runs one over all data that
is there (``availableNow``) into a Parquet sink with its checkpoint in the shared folder.
Late rows are those behind the watermark; ``kept_and_late`` keeps each batch's mark and
tells them apart, so none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.prefix import running
from ..session import new_path
from ..sources.stored_table import drain_into

DELAY = "1 hour"


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the files of a Parquet table, be it one file or a folder.

    A file source takes a folder or a pattern; written as a pattern a single file is one too.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame) -> DataFrame:
    """All that an append-mode job gives for the data that is there."""
    spark = stream.sparkSession
    out = new_path(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "checkpoint")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams that begin inside keep their state in RocksDB, on disk, which timers and several states need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def cycles(stream: DataFrame, work: Callable[[DataFrame, int], DataFrame], schema: str) -> DataFrame:
    """``work`` on every micro-batch of the stream; a batch that is run again replaces its own output."""
    spark = stream.sparkSession
    out = new_path(spark, "cycles")
    spark.createDataFrame([], schema).write.parquet(f"{out}/batch=-1")

    def run(batch: DataFrame, number: int) -> None:
        work(batch, number).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", new_path(spark, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def daily_topics(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Rows (ts, topic) counted by day and topic; a day is given once the watermark has passed it."""
    n = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "topic").agg(F.count("*").alias("n"))
    return n.select(F.col("w.start").alias("day"), "topic", "n")


def session_contexts(events: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """Sessions of each user: they end after ``gap`` without a row; their messages, last 10 kept by time."""
    held = events.withWatermark("ts", delay).groupBy("user", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ts", "id"))).alias("m"))
    last = F.slice(F.reverse("m"), 1, 10)
    return held.select("user", F.col("w.start").alias("start"), "n", F.transform(F.reverse(last), lambda x: x["id"]).alias("last"))


def unexpired(sessions: DataFrame, now: Column) -> DataFrame:
    """The rule of reading: an expired session is refused at once, even while its row is still there."""
    return sessions.where(F.col("expires_at") > now)


def deduplicated(requests: DataFrame, keys: list[str], delay: str = DELAY) -> DataFrame:
    """The first of requests with equal keys inside the watermark."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def failure_streaks(log: DataFrame, seconds: int = 300, least: int = 5) -> DataFrame:
    """Rows (client, id, ts, ok) with the failures of the last ``seconds`` since the last success: ``recent``, ``blocked``."""
    order = Window.partitionBy("client").orderBy("ts", "id")
    epoch = F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = log.withColumn("epoch", epoch).withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("client", "epoch").orderBy("s").rangeBetween(-seconds * 1_000_000, 0)
    recent = F.sum((~F.col("ok")).cast("long")).over(w)
    return rows.select("client", "id", recent.alias("recent"), (recent >= least).alias("blocked"))


def usage_report(log: DataFrame, minute: int = 3, day: int = 20, total_day: int = 100, total: int = 1000) -> DataFrame:
    """Days of each client (client, ts): requests, its busiest minute, all clients' requests that day and until then, and flags over the limits."""
    minutes = log.groupBy("client", F.window("ts", "1 minute").alias("m")).agg(F.count("*").alias("n"))
    days = minutes.groupBy("client", F.to_date("m.start").alias("day")).agg(F.sum("n").alias("requests"), F.max("n").alias("busiest"))
    all_days = days.groupBy("day").agg(F.sum("requests").alias("day_total"))
    # One row a day: a running sum over all days is small.
    lifetime = all_days.withColumn("lifetime", F.sum("day_total").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    over = [(F.col("busiest") > minute).alias("over_minute"), (F.col("requests") > day).alias("over_day"), (F.col("day_total") > total_day).alias("over_total_day"), (F.col("lifetime") > total).alias("over_lifetime")]
    return days.join(lifetime, "day").select("client", "day", "requests", "busiest", "day_total", "lifetime", *over)


def opened_sessions(log: DataFrame, limit: int = 20) -> DataFrame:
    """Sessions opened (address, ts) in each minute, and whether over ``limit``."""
    n = log.groupBy("address", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return n.select("address", F.col("w.start").alias("minute"), "n", (F.col("n") > limit).alias("over"))


def _count_on(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches)).sort_values(["ts", "id"])
    rows["seq"] = range(seen + 1, seen + len(rows) + 1)
    state.update((seen + len(rows),))
    yield rows[["session", "id", "seq"]]


def numbered(messages: DataFrame) -> DataFrame:
    """Messages (session, id, ts) with ``seq``: a counter a session that goes on over micro-batches."""
    return messages.select("session", "id", "ts").groupBy("session").applyInPandasWithState(_count_on, "session long, id long, seq long", "n long", "append", GroupStateTimeout.NoTimeout)


#: Batches after which all counters are written again.
SNAPSHOT = 32


def numbered_on(messages: DataFrame, root: str) -> DataFrame:
    """Messages (session, id, ts) with ``seq`` from 1 in each session, by (ts, id) within a micro-batch and on from batch to batch.

    A batch is numbered by ranges (``prefix.running``), so a long session is spread over tasks; what
    each session has reached is kept under ``root`` with the batch's number, and so are the
    rows: a batch that runs again replaces its own.  A later call goes on where this one ended.
    """
    spark = messages.sparkSession
    reached, rows = f"{root}/reached", f"{root}/rows"
    kind = dict(messages.dtypes)["session"]

    def before(number: int) -> DataFrame:
        empty = spark.createDataFrame([], f"session {kind}, n long, batch int")
        if number == 0:
            return empty.select("session", "n")
        since = (number - 1) // SNAPSHOT * SNAPSHOT
        held = spark.read.schema(empty.schema).parquet(reached).where((F.col("batch") < number) & (F.col("batch") >= since))
        return held.groupBy("session").agg(F.max("n").alias("n"))

    def work(batch: DataFrame, number: int) -> None:
        had = before(number)
        new = running(batch.select("session", "id", "ts"), ["session"], ["ts", "id"], {"k": F.lit(1)})
        on = new.join(had, "session", "left").select("session", "id", (F.coalesce("n", F.lit(0)) + F.col("k")).alias("seq"))
        on.write.mode("overwrite").parquet(f"{rows}/batch={number}")
        ends = spark.read.parquet(f"{rows}/batch={number}").groupBy("session").agg(F.max("seq").alias("n"))
        if number % SNAPSHOT == 0:
            ends = ends.unionByName(had).groupBy("session").agg(F.max("n").alias("n"))
        ends.write.mode("overwrite").parquet(f"{reached}/batch={number}")

    drain_into(messages, f"{root}/checkpoint", work)
    return spark.read.parquet(rows).drop("batch")


class _Expiry(StatefulProcessor):
    """A session's row: its latest write by time, and a timer for when it expires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", "at long, expires long, writes long")

    def _gone(self, key: tuple, row: tuple) -> Row:
        self.row.clear()
        return Row(session=key[0], expires=row[1], writes=row[2])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, expires, writes = self.row.get() if self.row.exists() else (None, None, 0)
        for r in rows:
            writes += 1
            if at is None or (r.at, r.expires) > (at, expires):
                at, expires = r.at, r.expires
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.row.update((at, expires, writes))
        due = -(-expires // 1000)
        if due <= timerValues.getCurrentWatermarkInMs():
            return iter([self._gone(key, (at, expires, writes))])
        self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return iter([self._gone(key, self.row.get())]) if self.row.exists() else iter([])

    def close(self) -> None:
        pass


def expired(writes: DataFrame, delay: str = DELAY) -> DataFrame:
    """Rows of a session table as they leave it: ``session``, ``expires_at``, ``writes`` of (session, ts, expires_at).

    The latest write of a session counts.  Its row leaves the state once the watermark has
    passed its time, by a timer: no other event of the session is needed.  A write that has
    expired when it comes leaves at once; one after that begins a new row.  Run it inside ``rocks_state``.
    """
    micros = writes.withWatermark("ts", delay).select("session", "ts", F.unix_micros("ts").alias("at"), F.unix_micros("expires_at").alias("expires"))
    kind = dict(writes.dtypes)["session"]
    out = micros.groupBy("session").transformWithState(_Expiry(), f"session {kind}, expires long, writes long", "append", "eventTime")
    return out.select("session", F.timestamp_micros("expires").alias("expires_at"), "writes")


def kept_and_late(rows: DataFrame, upto: Column, root: str, delay: str = DELAY) -> tuple[DataFrame, DataFrame]:
    """(kept, late) rows (ts, ...) of a stream: late are those whose ``upto`` the watermark had passed when their batch began.

    The mark of a batch is the greatest ``ts`` of all earlier ones, less ``delay``; each batch's
    greatest ``ts`` and rows are kept under ``root`` with its number, so a batch that runs again
    replaces its own and the two tables add up to the input.  A later call goes on where this one ended.
    """
    spark = rows.sparkSession

    def work(batch: DataFrame, number: int) -> None:
        mark = None
        if number:  # one row a batch
            marks = spark.read.schema("top timestamp, batch int").parquet(f"{root}/marks")
            mark = marks.where(F.col("batch") < number).agg((F.max("top") - F.expr(f"INTERVAL {delay}")).alias("m")).first().m
        late = F.lit(False) if mark is None else F.coalesce(upto <= F.lit(mark), F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{root}/rows/batch={number}")
        told = spark.read.schema(batch.schema).parquet(f"{root}/rows/batch={number}")
        told.agg(F.max("ts").alias("top")).write.mode("overwrite").parquet(f"{root}/marks/batch={number}")

    drain_into(rows, f"{root}/checkpoint", work)
    schema = StructType(list(rows.schema.fields)).add("late", "boolean")
    told = spark.read.schema(schema).parquet(f"{root}/rows").drop("batch")
    return told.where(~F.col("late")).drop("late"), told.where("late").drop("late")
