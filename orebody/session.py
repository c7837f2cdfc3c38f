"""Sessions and the folder that all nodes share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders made for local sessions, by application: Spark itself only tells a folder of its own inside.
_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a fresh folder of its own; on a cluster no
    local folder would do, as each executor would write to its own disk: that raises.  A
    session has one folder for its whole life.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or _made.get(context.applicationId) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _made[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


def _run_dir(spark: SparkSession) -> str:
    """The folder of what this session keeps; the same for its whole life."""
    return f"{shared_dir(spark)}/orebody-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{_run_dir(spark)}/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Delete every table that operators of this session have stored; frames made from them can no longer be read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
