"""Term statistics that follow a changing collection: signed steps by batch in a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.stored_table import StoredTable
from .topk import Statistics

SCHEMA = "kind string, term string, n long"
#: Partitions of the table, and changes after which each is made one folder again.
PARTS, COMPACT = 16, 16


class TermStatistics:
    """Document frequencies, the number of documents with tokens and their summed length, kept under ``path``.

    Each change appends its steps, +1 for what a document that comes has and -1 for one that
    goes; steps are added up when read, and by compaction.  A batch number that is in the
    table already changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = StoredTable(spark, path, SCHEMA, F.pmod(F.xxhash64("kind", "term"), F.lit(PARTS)))

    @staticmethod
    def steps(docs: DataFrame, sign: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``kind``, ``term``, ``n`` of the rows of ``docs``: ``df`` of each term, ``docs`` and ``words`` in all."""
        words = docs.select(tokens(F.col(text_col)).alias("w")).where(F.size("w") > 0)
        each = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).select(F.lit("df").alias("kind"), "term", "n")
        total = words.agg(F.count("*").alias("d"), F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("s"))
        both = total.select(F.inline(F.array(F.struct(F.lit("docs").alias("kind"), F.lit("").alias("term"), F.col("d").alias("n")), F.struct(F.lit("words").alias("kind"), F.lit("").alias("term"), F.col("s").alias("n")))))
        return each.unionByName(both).withColumn("n", (F.col("n") * sign).cast("long"))

    def update(self, added: DataFrame | None = None, removed: DataFrame | None = None, batch: int | None = None) -> bool:
        """Documents (doc_id, text) come and go; False where ``batch`` was there already.  A changed document goes and comes."""
        steps = [self.steps(docs, sign) for docs, sign in ((added, 1), (removed, -1)) if docs is not None]
        if not steps:
            return False
        rows = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1]).groupBy("kind", "term").agg(F.sum("n").alias("n"))
        done = self.table.append(rows.where("n <> 0"), batch)
        if done and (self.table.version() + 1) % COMPACT == 0:
            self.compact()
        return done

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("kind", "term").agg(F.sum("n").alias("n")).where("n <> 0")

    def compact(self) -> None:
        self.table.change(self._summed)

    def frequency(self) -> DataFrame:
        """``term``, ``df`` of the terms that documents have now."""
        return self._summed(self.table.read().where("kind = 'df'")).select("term", F.col("n").alias("df"))

    def now(self) -> Statistics:
        """What scoring needs: frequencies as a table, the number of documents and the mean length of their one field."""
        totals = {r.kind: r.n for r in self._summed(self.table.read().where("kind <> 'df'")).collect()}
        n = totals.get("docs", 0)
        return Statistics(self.frequency(), n, {"text": totals.get("words", 0) / max(n, 1)})
