"""Where operators keep what must outlive an executor.

Lineage is cut either with ``checkpoint()`` or with a Parquet table, both in the shared
folder of the session (``orebody.session.shared_dir``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from orebody.session import new_path, shared_dir

__all__ = ["cut", "new_path", "shared_dir", "stored"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by an eager, reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
