"""Mixing sources to target weights by the cube method of balanced sampling.

Every source gets a target number of words.  The expected copies of a document
are its source's target over its source's size, at most ``most`` of them: the whole
part is taken surely, the fraction is an inclusion probability.

The cube method (Deville and Tillé, "Efficient balanced sampling: the cube method",
2004) moves the vector of probabilities inside the null space of the balancing
constraints until it meets a face of the unit cube.  Here the constraints are the
document total and the word total of a source.  Each step looks at three undecided
documents, which always have a direction that keeps both totals, and decides at
least one of them; at most two stay undecided.

A source may hold any share of the rows, so its documents are dealt over blocks by
a hash; each block is balanced alone, and what each leaves undecided meets in the
blocks of the next level, until one block a source is left.  Only there the last
two documents land: in the way that comes nearest to the target.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Documents a block is meant to hold.
BLOCK = 4096
WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move ``p`` to 0 or 1 but for at most two, keeping sum(p) and sum(p * size)."""
    p, size = p.astype(float).copy(), size.astype(float)
    order = rng.permutation(len(p))
    held: list[int] = []
    coins = rng.random(len(p))
    for at, unit in enumerate(order):
        if not _EPS < p[unit] < 1 - _EPS:
            p[unit] = round(p[unit])
            continue
        held.append(int(unit))
        if len(held) < 3:
            continue
        a, b, c = held
        # The direction orthogonal to (1, 1, 1) and to the three sizes.
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / d if d > 0 else -p[i] / d for i, d in zip(held, u, strict=True) if d)
        down = min(p[i] / d if d > 0 else (p[i] - 1) / d for i, d in zip(held, u, strict=True) if d)
        step = up if coins[at] * (up + down) < down else -down
        for i, d in zip(held, u, strict=True):
            p[i] += step * d
            if p[i] < _EPS or p[i] > 1 - _EPS:
                p[i] = round(p[i])
        held = [i for i in held if 0 < p[i] < 1]
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide what ``flight`` left so that the word total comes nearest to its expectation.

    Ties fall to fewer documents, then to the order of the units.
    """
    p = p.astype(float).copy()
    left = [i for i in range(len(p)) if 0 < p[i] < 1]
    want = sum(p[i] * size[i] for i in left)
    ways = ([i for k, i in enumerate(left) if bits >> k & 1] for bits in range(1 << len(left)))
    best = min(ways, key=lambda way: (abs(sum(size[i] for i in way) - want), len(way), way))
    p[left] = 0
    p[best] = 1
    return p


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source``, ``source_size`` with ``target``: weighted shares of ``share`` x all sizes.

    Sources are ordered by code point, null last, and take ``weights`` in turn.  A
    target stops at ``most`` times its source's size; the excess is dealt to the others
    by weight until none is above.  One row a source goes in and comes out.
    """
    totals = stored(_numbered(totals).withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("n") % len(weights) + 1).cast("int"))), "sources")
    most_of = F.col("source_size") * F.lit(float(most))
    level = float("inf")  # words a unit of weight; sources at or above their stop leave the sharing
    total = float(totals.agg(F.sum("source_size")).first()[0] or 0) * share
    at_stop = F.lit(False)
    while True:
        open_ = totals.where(~at_stop).agg(F.sum("w")).first()[0]
        if not open_:
            break
        capped = totals.where(at_stop).agg(F.sum(most_of)).first()[0] or 0.0
        level = (total - capped) / open_
        above = most_of < F.col("w") * F.lit(level)
        if not totals.where(~at_stop & above).limit(1).count():
            break
        at_stop = at_stop | above
    target = F.when(at_stop, most_of).otherwise(F.col("w") * F.lit(level if level < float("inf") else 0.0))
    return totals.select("source", "source_size", target.alias("target"))


def _numbered(totals: DataFrame) -> DataFrame:
    """``totals`` with ``n``, its place from 0 by source, null last; no task sees all rows."""
    ranged = totals.repartitionByRange(F.col("source").isNull(), F.col("source"))
    parts = stored(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("part").agg(F.count("*").alias("held"))
    before = sizes.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return parts.withColumn("k", F.row_number().over(inside) - 1).join(before, "part").select("source", "source_size", (F.col("k") + F.col("before")).alias("n"))


def _counted(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``k``, from 0 among rows of equal id, source and size, which nothing else tells apart.

    Equal rows are counted before they are shuffled and written out again by many tasks, so that a
    hash of (id, size, k) deals them evenly however many there are.
    """
    same = rows.groupBy("id", "source", "size").agg(F.count("*").alias("n"))
    parts = same.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block)))).repartition("id", "source", "size", "part")
    last = F.least((F.col("part") + 1) * block, F.col("n")) - 1
    return parts.select("id", "source", "size", F.explode(F.sequence(F.col("part") * block, last)).alias("k")).withColumn("k", F.col("k").cast("int"))


def _decide(rows: DataFrame, last: bool) -> DataFrame:
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "id", "size"], kind="stable").reset_index(drop=True)
        seed = zlib.crc32(repr([None if x is None else str(x) for x in key]).encode())
        size = part["size"].to_numpy()
        p = flight(part["p"].to_numpy(), size, np.random.default_rng(seed))
        return part.assign(p=land(p, size) if last else p)

    return rows.groupBy("source", "level", "block").applyInPandas(run, rows.schema)


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int = BLOCK,
) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``size`` counts the text's words (null: none), ``copies`` is 0 to ``most`` and
    ``taken`` = copies x size.  Rows without words are taken as others of their source.
    Where all sizes of a source are zero its target is zero and nothing is taken.
    Null sources are one source, the last; null ids stay null; repeated rows are
    documents of their own; an empty table gives an empty result.  Reruns agree:
    order and coins come from hashes.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size")), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = source_targets(totals.select("source", "source_size"), weights, share, most)
    wide = targets.join(totals.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    wide = stored(wide, "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    small = wide.select(F.col("source").alias("s"), "rows", "source_size", "target", ratio.alias("ratio"), F.floor(ratio + F.lit(_EPS)).alias("sure"))
    units = _counted(rows, block).join(small, F.col("source").eqNullSafe(F.col("s"))).select(
        "id", "source", "size", "source_size", "target", "sure",
        F.greatest(F.lit(0.0), F.col("ratio") - F.col("sure")).alias("p"),
        F.when(F.col("k") == 0, F.xxhash64("id", "size")).otherwise(F.xxhash64("id", "size", "k")).alias("h"),
        F.lit(0).alias("level"),
        F.pmod(F.xxhash64("id", "size", "k"), F.ceil(F.col("rows") / block)).cast("int").alias("block"),
        F.ceil(F.col("rows") / block).cast("int").alias("blocks"),
    )
    deepest, blocks = 0, (wide.agg(F.max(F.ceil(F.col("rows") / block))).first()[0] or 1)
    done: list[DataFrame] = []
    while True:
        several = F.col("blocks") > 1
        decided = stored(_decide(units.where(several), False).unionByName(_decide(units.where(~several), True)) if blocks > 1 else _decide(units, True), "decided")
        if blocks <= 1:
            done.append(decided)
            break
        open_ = several & (F.col("p") > 0) & (F.col("p") < 1)
        done.append(decided.where(~open_))
        # Of each block at most two documents go on.
        deepest += 1
        blocks = -(-2 * blocks // block)
        next_blocks = F.ceil(2 * F.col("blocks") / block).cast("int")
        units = decided.where(open_).withColumns({
            "level": F.lit(deepest),
            "block": F.pmod(F.xxhash64("h", F.lit(deepest)), next_blocks).cast("int"),
            "blocks": next_blocks,
        })
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    copies = (F.col("sure") + F.round("p")).cast("long")
    return every.select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
