"""Running totals whose keys may be hot: two levels, ranges and offsets.

Rows are dealt by ranges of (key, order), so a key with half of all rows lies in half of the
partitions.  Each (key, partition) is summed up by itself; the running total over a key's
partitions, one row each, gives every partition its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column | str]) -> DataFrame:
    """``df`` with a column for each of ``sums``: the total of its value over the rows of equal ``by`` up to this one in ``order``.

    ``order`` must tell the rows of a key apart.  Nulls of ``by`` are one key; null values count as none.
    """
    values = {f"__v{i}": F.coalesce(v if isinstance(v, Column) else F.col(v), F.lit(0)) for i, v in enumerate(sums.values())}
    dealt = df.withColumns(values).repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id())
    rows = stored(dealt, "ranges")
    per = rows.groupBy(*by, "__part").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__part").alias("__p"), *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__o{i}") for i, v in enumerate(values)])
    offsets = stored(offsets, "offsets")
    upto = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"__l{i}": F.sum(v).over(upto) for i, v in enumerate(values)})
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    found = local.join(offsets, same)
    kept = [c for c in df.columns if c not in sums]
    return found.select(*kept, *[(F.col(f"__l{i}") + F.col(f"__o{i}")).alias(name) for i, name in enumerate(sums)])


def percentiles(rows: DataFrame, by: list[str], value: str, nearest: dict[str, float], between: dict[str, float] | None = None) -> DataFrame:
    """Exact percentiles of ``value`` for each group of ``by``, as doubles: the least value whose share of rows reaches it, and interpolated ones.

    ``nearest`` and ``between`` name the columns and their shares.  Values are ranked by ranges
    (``running``) and picked by rank, so a group of any size is spread over tasks and none holds its
    values.  Null values take no part; a group without others has no row.
    """
    between = between or {}
    kept = rows.select(*by, F.col(value).cast("double").alias("__value")).where("__value is not null")
    ranked = running(kept, by, ["__value"], {"__rank": F.lit(1)})
    n = kept.groupBy(*[F.col(c).alias(f"__n{i}") for i, c in enumerate(by)]).agg(F.count("*").alias("__n"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__n{i}"))
    both = ranked.join(n, same) if by else ranked.crossJoin(n)
    x, rank, size = F.col("__value"), F.col("__rank"), F.col("__n")
    near = [F.min(F.when(rank / size >= p, x)).alias(name) for name, p in nearest.items()]
    mixed = []
    for name, p in between.items():
        at = (size - 1) * F.lit(p)
        low, high = F.max(F.when(rank == F.floor(at) + 1, x)), F.max(F.when(rank == F.ceil(at) + 1, x))
        part = F.max(at - F.floor(at))
        mixed.append((low + (high - low) * part).alias(name))
    return both.groupBy(*by).agg(*near, *mixed)
