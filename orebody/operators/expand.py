"""Joins on keys that very many rows share, whose result is far larger than either side.

Left and right rows of a key are cut into parts of about ``BLOCK`` rows and each part meets each
part once, so a key of many rows is spread over many tasks and what is shuffled is some (1 / BLOCK)
of the result.  Tasks are numbered by the size of the result, which adaptive execution cannot see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Rows of a part; rows of the result a task; tasks at most.
BLOCK, ROWS, MOST_TASKS = 2_000, 2_000_000, 10_000


#: Rows of a task of a table that is dealt by its size.
DEALT = 250_000


def tasks_for(*tables: DataFrame) -> int:
    """Tasks, so that one has some ``DEALT`` rows of ``tables`` however large they are."""
    return min(sum(t.count() for t in tables) // DEALT + 1, MOST_TASKS)


def expanded(left: DataFrame, right: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """``left.join(right, keys)``; the sides have no other column in common, and their order inside a key is of no account."""
    left, right = stored(left, "left"), stored(right, "right")
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    sizes = stored(n(left, "__n").join(n(right, "__m"), keys), "sizes")
    rows = sizes.agg(F.sum(F.col("__n").cast("double") * F.col("__m"))).first()[0] or 0
    tasks = max(1, min(int(rows // ROWS) + 1, MOST_TASKS))
    parts = lambda c: F.ceil(F.col(c) / block).cast("int")
    cuts = sizes.select(*keys, parts("__n").alias("__i"), parts("__m").alias("__j"))

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        others = [c for c in df.columns if c not in keys]
        part = F.pmod(F.xxhash64(*others), F.col(mine)).cast("int") if others else F.lit(0)
        each = df.join(cuts, keys).withColumn(mine, part).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return each.repartition(tasks, *keys, "__i", "__j")

    return dealt(left, "__i", "__j").hint("merge").join(dealt(right, "__j", "__i"), [*keys, "__i", "__j"]).drop("__i", "__j")
