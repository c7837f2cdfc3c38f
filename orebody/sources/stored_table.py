"""Tables in a folder that are changed by one atomic step, and reports that are never overwritten.

Data goes to a new folder first; then one small file, the manifest of the next version, is
put in its place by a rename that fails where the name is taken.  Readers take the newest
manifest, so they see a change whole or not at all, and of two writers of one version one
fails.  A manifest lists the folders of each partition, so a change replaces the
partitions that it brings and leaves the others where they are; it also keeps the numbers of
the batches that it holds, so a batch that runs again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import upsert

PART = "__part"


class TakenError(RuntimeError):
    """Another writer has made this version, or a report of this name is there."""


class StoredTable:
    """A table of ``schema`` under ``path``, in partitions by the value of ``part`` (at most some thousand)."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, part: Column) -> None:
        self.spark, self.path, self.part = spark, path.rstrip("/"), part
        self.schema = spark.createDataFrame([], schema).schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at = self._hadoop.Path(f"{self.path}/manifests")
        if not self._files.exists(at):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _manifest(self) -> tuple[int, dict]:
        versions = self._versions()
        if not versions:
            return -1, {"parts": {}, "batches": []}
        stream = self._files.open(self._hadoop.Path(f"{self.path}/manifests/{versions[-1]}.json"))
        try:
            return versions[-1], json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _switch(self, version: int, manifest: dict) -> None:
        """Make ``manifest`` version ``version``; raises where it is there."""
        staged = self._hadoop.Path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._files.create(staged, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if version in self._versions() or not self._files.rename(staged, self._hadoop.Path(f"{self.path}/manifests/{version}.json")):
            self._files.delete(staged, False)
            raise TakenError(f"version {version} of {self.path} was written by another")

    def version(self) -> int:
        """The number of the newest version, -1 before the first."""
        return max(self._versions(), default=-1)

    def read(self) -> DataFrame:
        """The rows of the newest version."""
        _, manifest = self._manifest()
        folders = [f"{self.path}/{f}" for fs in manifest["parts"].values() for f in fs]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _staged(self, df: DataFrame) -> dict[str, str]:
        """``df`` written to a new folder: the folder of each partition."""
        root = f"data/{uuid.uuid4().hex}"
        df.select([f.name for f in self.schema]).withColumn(PART, self.part).write.partitionBy(PART).parquet(f"{self.path}/{root}")
        names = [s.getPath().getName() for s in self._files.listStatus(self._hadoop.Path(f"{self.path}/{root}"))]
        return {n: f"{root}/{n}" for n in names if n.startswith(f"{PART}=")}

    def change(self, work: Callable[[DataFrame], DataFrame], batch: int | None = None, touched: DataFrame | None = None, append: bool = False) -> bool:
        """Replace partitions by the rows that ``work`` makes of them; False where ``batch`` is in the table already.

        ``work`` gets the rows of the partitions that ``touched`` has rows of (all, if None) and
        gives their new rows; with ``append`` it gets none and its rows are added.
        """
        version, manifest = self._manifest()
        if batch is not None and batch in manifest["batches"]:
            return False
        parts = manifest["parts"]
        if append:
            chosen: list[str] = []
        elif touched is None:
            chosen = list(parts)
        else:
            values = touched.select(self.part.cast("string").alias("p")).distinct().collect()
            chosen = [f"{PART}={r.p}" for r in values if f"{PART}={r.p}" in parts]
        folders = [f"{self.path}/{f}" for p in chosen for f in parts[p]]
        had = self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)
        new = self._staged(work(had))
        kept = {p: f for p, f in parts.items() if p not in chosen}
        for p, folder in new.items():
            kept[p] = [*kept.get(p, []), folder]
        self._switch(version + 1, {"parts": kept, "batches": manifest["batches"] + ([batch] if batch is not None else [])})
        return True

    def append(self, df: DataFrame, batch: int | None = None) -> bool:
        return self.change(lambda _: df, batch, append=True)

    def upsert(self, rows: DataFrame, key: str, order: str, batch: int | None = None) -> bool:
        """Whole rows replace those of equal ``key``, which ``part`` must follow from; only the partitions of ``rows`` are read and written."""
        return self.change(lambda had: upsert(had, rows, key, order), batch, touched=rows)

    def compact(self) -> None:
        """Each partition in one folder again."""
        self.change(lambda had: had)

    def expire(self) -> None:
        """Delete what only older versions use.  For times without readers of older versions."""
        versions = self._versions()
        _, manifest = self._manifest()
        used = {f for fs in manifest["parts"].values() for f in fs}
        data = self._hadoop.Path(f"{self.path}/data")
        for root in self._files.listStatus(data) if self._files.exists(data) else []:
            for folder in self._files.listStatus(root.getPath()):
                if f"data/{root.getPath().getName()}/{folder.getPath().getName()}" not in used:
                    self._files.delete(folder.getPath(), True)
        for v in versions[:-1]:
            self._files.delete(self._hadoop.Path(f"{self.path}/manifests/{v}.json"), False)


def drain_into(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], object]) -> None:
    """Every micro-batch of the data that is there goes to ``write`` with its number; a later call goes on behind it."""
    stream.writeStream.foreachBatch(lambda batch, number: write(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def write_report(df: DataFrame, path: str) -> None:
    """``df`` as JSON lines under ``path``; raises where a report is there, and is there whole or not at all."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    final, staged = hadoop.Path(path), hadoop.Path(f"{path.rstrip('/')}.{uuid.uuid4().hex}")
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(final):
        raise TakenError(f"a report is at {path}")
    df.write.mode("errorifexists").json(staged.toString())
    # A rename onto a folder that came meanwhile would move into it.
    if files.exists(final) or not files.rename(staged, final):
        files.delete(staged, True)
        raise TakenError(f"a report is at {path}")
