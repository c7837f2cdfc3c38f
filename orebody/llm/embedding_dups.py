"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines.

For unit vectors a cosine of at least ``least`` is a distance of at most
sqrt(2 - 2 least).  A table hashes a vector by ``k`` quantised Gaussian projections,
floor((a.v + b) / width) (Datar et al., "Locality-sensitive hashing scheme based on
p-stable distributions", 2004).  ``k`` grows with the logarithm of the number of
vectors, so that unrelated vectors share few buckets, and the number of tables
follows from the recall wanted of a pair that only just links.

Equal vectors are one before hashing.  A bucket of more than ``BLOCK`` vectors is cut
into blocks, and pairs of blocks become groups of their own: no task holds a bucket,
and no pair is skipped.  Cosines are counted inside tasks; pairs are not written.
Each pair counts in the first table that it shares only.  For the components a
group writes a star over each set of vectors that its links connect.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import stored

WIDTH, RECALL, BLOCK, SEED = 2.0, 0.98, 512, 11
#: Groups up to this size are compared pair by pair, all of a batch at once.
_SMALL = 8


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection agrees at ``distance``."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def shape(n: int, least: float = 0.95, recall: float = RECALL) -> tuple[int, int]:
    """Projections a table and tables for ``n`` vectors."""
    near, far = collision(math.sqrt(2 - 2 * least)), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


class Tables:
    """The hash functions; any task builds the same ones from the seed."""

    def __init__(self, k: int, tables: int, seed: int = SEED) -> None:
        self.k, self.tables, self.seed = k, tables, seed
        self._made: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables) signed 64-bit bucket keys of the rows of ``unit``."""
        dim = unit.shape[1]
        if dim not in self._made:
            rng = np.random.default_rng((self.seed, dim))
            m = self.k * self.tables
            mix = rng.integers(1, 1 << 62, (self.k,), dtype=np.int64) * 2 + 1
            self._made[dim] = rng.normal(size=(dim, m)), rng.random(m) * WIDTH, mix
        a, b, mix = self._made[dim]
        cells = np.floor((unit @ a + b) / WIDTH).astype(np.int64).reshape(len(unit), self.tables, self.k)
        with np.errstate(over="ignore"):
            return (cells * mix).sum(axis=2) + dim


def unit_rows(raw: list[bytes]) -> np.ndarray:
    """Rows of length one from float64 bytes of one dimension."""
    x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_dim(raw: list[bytes]) -> Iterator[np.ndarray]:
    """Indices of the rows of each dimension."""
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def _hash(tables: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vid, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for rows in _by_dim(raw):
                for at in range(0, len(rows), 2048):
                    part = rows[at : at + 2048]
                    keys = tables.keys(unit_rows([raw[i] for i in part]))
                    t = np.broadcast_to(np.arange(tables.tables, dtype=np.int32), keys.shape)
                    ids = np.broadcast_to(vid[part][:, None], keys.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (t, keys, ids)], names=["t", "key", "vid"])

    return run


def _labels(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the least row that its links reach."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compare(tables: Tables, least: float):
    """Tasks' function over rows sorted by group: ``vid``, ``add`` (links), ``other`` (connected to)."""

    def large(t: int, cross: bool, side: np.ndarray, vid: np.ndarray, copies: np.ndarray, unit: np.ndarray, out: list) -> None:
        linked = unit @ unit.T >= least
        np.fill_diagonal(linked, False)
        if cross:
            linked &= side[:, None] != side[None, :]
        if not linked.any():
            return
        label = _labels(linked)
        new = linked.copy()
        keys = tables.keys(unit)
        for s in range(t):
            new &= keys[:, s][:, None] != keys[:, s][None, :]
        add = new @ copies
        hit = linked.any(axis=1)
        other = vid[label]
        out.append((vid[hit], add[hit], other[hit]))

    def small(t: np.ndarray, group: np.ndarray, side: np.ndarray, cross: np.ndarray, vid: np.ndarray, copies: np.ndarray, unit: np.ndarray, out: list) -> None:
        for d in range(1, _SMALL):
            if d >= len(group):
                break
            a = np.flatnonzero(group[:-d] == group[d:])
            b = a + d
            ok = ~cross[a] | (side[a] != side[b])
            a, b = a[ok], b[ok]
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
            a, b = a[near], b[near]
            if not len(a):
                continue
            same = tables.keys(unit[a]) == tables.keys(unit[b])
            first = same.argmax(axis=1) == t[a]
            out.append((vid[a], np.where(first, copies[b], 0), vid[b]))
            out.append((vid[b], np.where(first, copies[a], 0), vid[a]))

    def work(rows: list) -> Iterator[pa.RecordBatch]:
        t, group, side, cross, vid, copies, raw = rows
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(group)])))
        of_small = np.repeat(sizes <= _SMALL, sizes)
        for mine in _by_dim(raw):
            mine = mine[of_small[mine]]
            if len(mine):
                small(t[mine], group[mine], side[mine], cross[mine], vid[mine], copies[mine], unit_rows([raw[i] for i in mine]), out)
        for at, size in zip(starts[sizes > _SMALL], sizes[sizes > _SMALL], strict=True):
            s = np.arange(at, at + size)
            for mine in _by_dim([raw[i] for i in s]):
                i = s[mine]
                large(int(t[at]), bool(cross[at]), side[i], vid[i], copies[i], unit_rows([raw[x] for x in i]), out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=["vid", "add", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = dict(zip(batch.schema.names, batch.columns, strict=True))
            now = [names["t"].to_numpy(), names["grp"].to_numpy(), names["b"].to_numpy(), names["i"].to_numpy() != names["j"].to_numpy(), names["vid"].to_numpy(), names["copies"].to_numpy(), names["raw"].to_pylist()]
            if held is not None:
                now = [x + y if isinstance(x, list) else np.concatenate((x, y)) for x, y in zip(held, now, strict=True)]
            last = int(np.flatnonzero(np.concatenate(([True], now[1][1:] != now[1][:-1])))[-1])
            if last:
                yield from work([x[:last] for x in now])
            held = [x[last:] for x in now]
        if held is not None and len(held[1]):
            yield from work(held)

    return run


def distinct_vectors(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(``id``, ``vec``: null where the vector links with nothing) and (``vid``, ``vec``, ``low``, ``copies``)."""
    vec = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce(F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False))
    clean = F.transform(vec, lambda x: x + 0.0)  # -0.0 is 0.0
    every = rows.select(F.col(id_col).cast("long").alias("id"), F.when(good, clean).alias("vec"))
    one = every.where("vec is not null").groupBy("vec").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    return every, stored(one.withColumn("vid", F.monotonically_increasing_id()), "vectors")


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vecs = batch.column(0)
        flat, ends = vecs.flatten().to_numpy().astype("<f8"), np.cumsum(vecs.value_lengths().to_numpy())
        raw = [x.tobytes() for x in np.split(flat, ends[:-1])] if batch.num_rows else []
        yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), *batch.columns[1:]], names=["raw", "vid", "copies"])


def links(one: DataFrame, least: float = 0.95, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``vid``, ``add``, ``other``: sums of ``add`` are links to rows of other vectors, ``other`` is connected to ``vid``."""
    tables = Tables(*shape(one.count(), least, recall))
    raw = stored(one.select("vec", "vid", "copies").mapInArrow(_raw, "raw binary, vid long, copies long"), "raw")
    keys = stored(raw.select("vid", "raw").mapInArrow(_hash(tables), "t int, key long, vid long"), "keys")
    # Written first, so that the join stands on its own and a bucket of very many can be split.
    shared = stored(keys.groupBy("t", "key").agg(F.count("*").alias("m")).where("m > 1"), "shared")
    blocks = F.ceil(F.col("m") / block).cast("int")
    dealt = keys.join(shared, ["t", "key"]).select("t", "key", "vid", F.pmod(F.xxhash64("vid", "t"), blocks).cast("int").alias("b"), blocks.alias("nb"))
    dealt = dealt.select("t", "key", "vid", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    dealt = dealt.select("t", "key", "vid", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    full = dealt.join(raw, "vid").withColumn("grp", F.xxhash64("t", "key", "i", "j"))
    # Groups whose 64-bit digests clash would be compared together, at worst counting a true link of both twice.
    grouped = full.repartition("grp").sortWithinPartitions("grp", "t", "key", "i", "j", "b", "vid")
    return grouped.mapInArrow(_compare(tables, least), "vid long, add long, other long")


def embedding_groups(rows: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``rows``: ``id``, ``n_links``, ``component``, ``kept``.

    ``n_links`` counts the other rows whose cosine with this one is at least ``least``
    in double precision; every one counted is checked, and a pair at the threshold is
    found with a chance of at least ``recall``, a nearer one with more.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different length.  Repeated rows are vectors of their
    own.  Null ids count as links but name no component; ``kept`` is false for them.
    An empty table gives an empty result; other columns are not read.
    """
    every, one = distinct_vectors(rows, id_col, vector_col)
    found = stored(links(one, least, recall, block), "links")
    comps = connected_components(found.select(F.col("vid").alias("a"), F.col("other").alias("b")))
    named = one.select("vid", "low", "copies").join(comps, one.vid == comps.node, "left").withColumn("label", F.coalesce("component", "vid"))
    lows = stored(named.groupBy("label").agg(F.min("low").alias("component_low")), "lows")
    n = found.groupBy("vid").agg(F.sum("add").alias("n"))
    told = named.join(lows, "label").join(n, "vid", "left")
    told = stored(told.select("vid", F.col("component_low").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "told")
    by_vec = one.select("vec", "vid").join(told, "vid").drop("vid")
    out = every.join(by_vec, "vec", "left")
    component = F.when(F.col("vec").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


#: DuckDB SQL of the registered query, by all pairs.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
  WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)
"""
