"""Product codes of vectors, by Lloyd rounds whose members stay where they are.

A vector of integers is cut into ``PARTS`` equal parts, and each part position has a
codebook of at most ``ENTRIES`` entries.  A member is a part of a vector; blocks of members
are dealt by (position, entry, salt), so that each block lies with an owner of its entry.
In a round owners sum up the members that lie with them and hand on one sum for each entry;
with the new codebooks, which are ``ENTRIES`` vectors in size and so go to every task, they
look for each member's nearest entry.  Members that change it leave in blocks of their own,
and only these are shuffled, to their new owners; what stays and what comes have one
partitioner, so their union moves nothing.

The salt, of the batch that a member came in, spreads an entry over many owners even if all
vectors choose it.  Blocks need a partitioner that outlives a round, which tables do not
have once Python has looked at their rows: hence pair RDDs of arrays here, and nowhere else.
Each round's members are checkpointed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import shared_dir, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers end here on both sides: squared distances and sums of vectors stay within 64 bits.
MOST = 1 << 26
#: Salts of an entry at least, and members of one owner, about, if all vectors chose the same entry.
SALTS, OWNED = 16, 100_000
#: Members whose distances stand in memory at once.
SLICE = 8192

Codebooks = list[np.ndarray]  # one (entries, part length) array of int64 for each position


def integers(rows: DataFrame, id_col: str, vector_col: str, keep: tuple[str, ...] = (), scale: int = SCALE) -> DataFrame:
    """``id``, *keep, ``ints``: floor(scale x component) as longs, of vectors that have no null or non-finite component; null or empty ones are left out."""
    vec = F.col(vector_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vec, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(MOST))), F.lit(float(-MOST)))))
    return rows.where(vec.isNotNull() & (F.size(vec) > 0) & finite).select(F.col(id_col).alias("id"), *keep, whole.alias("ints"))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of ``parts`` (ties to the lower number) and its squared distance."""
    which, far = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
    for at in range(0, len(parts), SLICE):
        some = parts[at : at + SLICE]
        d = np.zeros((len(some), len(book)), dtype=np.int64)
        for j in range(book.shape[1]):
            x = some[:, j, None] - book[None, :, j]
            d += x * x
        best = d.argmin(axis=1)
        which[at : at + SLICE], far[at : at + SLICE] = best, d[np.arange(len(some)), best]
    return which, far


def first_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the ``entries`` vectors of least id, those of equal id by their integers; vectors without an id come last."""
    least = vectors.select("id", "ints").orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()
    whole = np.array([r.ints for r in least], dtype=np.int64)
    return list(np.split(whole, parts, axis=1)) if len(least) else []


Key = tuple[int, int, int]  # position, entry, salt


def _owner(key: Key) -> int:
    """The number of the partition, but for the modulus, that owns a key."""
    position, entry, salt = key
    return position * 257 + entry * 16 + salt * 8191


def _split(position: int, salt: int, parts: np.ndarray, entry: np.ndarray) -> Iterator[tuple[Key, np.ndarray]]:
    """``parts`` as one block for each of the entries that they chose."""
    order = np.argsort(entry, kind="stable")
    numbers, starts = np.unique(entry[order], return_index=True)
    for e, rows in zip(numbers.tolist(), np.split(order, starts[1:]), strict=True):
        yield (position, e, salt), parts[rows]


def _first_blocks(books: Codebooks, salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            whole = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int32)
            salt = (task * 31 + number) % salts
            found = [x for p, part in enumerate(np.split(whole, len(books), axis=1)) for x in _split(p, salt, part, nearest(part.astype(np.int64), books[p])[0])]
            keys = list(zip(*[k for k, _ in found], strict=True))
            yield pa.RecordBatch.from_arrays([*[pa.array(k, pa.int32()) for k in keys], pa.array([x.tobytes() for _, x in found], pa.binary())], names=["position", "entry", "salt", "block"])

    return run


def _sums(blocks: Iterator[tuple[Key, np.ndarray]]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """Count and sum of what lies here, for each entry."""
    out: dict[tuple[int, int], np.ndarray] = {}
    for (position, entry, _), block in blocks:
        mine = np.concatenate(([len(block)], block.sum(axis=0, dtype=np.int64)))
        out[position, entry] = out.get((position, entry), 0) + mine
    return iter(out.items())


def _told(books: Codebooks):
    """Blocks of those that stay, under their key, and of those that leave, under the new one; the flag tells which."""

    def run(blocks: Iterator[tuple[Key, np.ndarray]]) -> Iterator[tuple[Key, tuple[bool, np.ndarray]]]:
        for (position, entry, salt), block in blocks:
            for key, part in _split(position, salt, block, nearest(block.astype(np.int64), books[position])[0]):
                yield key, (key[1] != entry, part)

    return run


def _joined(blocks: Iterator[tuple[Key, np.ndarray]]) -> Iterator[tuple[Key, np.ndarray]]:
    """One block for each key that lies here."""
    held: dict[Key, list[np.ndarray]] = {}
    for key, block in blocks:
        held.setdefault(key, []).append(block)
    return ((key, np.concatenate(some)) for key, some in held.items())


def _settled(members: RDD) -> RDD:
    """``members`` kept for its readers and checkpointed by the first of them."""
    kept = members.mapPartitions(_joined, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
    kept.checkpoint()
    return kept


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` of assignment and update, from the vectors of least id; ``vectors`` has ``id``, ``ints`` of one length.

    An entry becomes its members' mean, each component rounded down; one without members stays.
    """
    books = first_books(vectors, parts, entries)
    if not books or not rounds:
        return books
    shared_dir(vectors.sparkSession)
    n = vectors.count()
    salts = max(SALTS, -(-n // OWNED))
    partitions = min(max(2 * parts, -(-n * parts // OWNED)), 100_000)
    length = books[0].shape[1]
    rows = vectors.select("ints").mapInArrow(_first_blocks(books, salts), "position int, entry int, salt int, block binary").rdd
    blocks = rows.map(lambda r: ((r[0], r[1], r[2]), np.frombuffer(r[3], dtype=np.int32).reshape(-1, length)))
    members = _settled(blocks.partitionBy(partitions, _owner))
    for left in reversed(range(rounds)):
        # At most positions x entries sums.
        total = members.mapPartitions(_sums).reduceByKey(np.add, numPartitions=parts).collect()
        books = [b.copy() for b in books]
        for (position, entry), x in total:
            books[position][entry] = x[1:] // x[0]
        if left:
            told = members.mapPartitions(_told(books), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
            stay = told.filter(lambda x: not x[1][0]).mapValues(lambda v: v[1])
            # A plain map drops the partitioner, which does not hold for those that leave.
            moved = told.filter(lambda x: x[1][0]).map(lambda x: (x[0], x[1][1])).partitionBy(partitions, _owner)
            then = _settled(stay.union(moved))
            then.count()
            told.unpersist()
            members.unpersist()
            members = then
    members.unpersist()
    return books


def coded(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``vectors`` with ``code`` (the number of each part's nearest entry, two hex digits each) and ``error`` (squared distances, summed over parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            whole = batch.column(batch.schema.get_field_index("ints")).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            found = [nearest(part, book) for part, book in zip(np.split(whole, len(books), axis=1), books, strict=True)]
            which = np.stack([w for w, _ in found], axis=1).astype(np.uint8)
            far = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes().hex() for r in which]), pa.array(far)], names=[*batch.schema.names, "code", "error"])

    schema = StructType(list(vectors.schema.fields)).add("code", "string").add("error", "long")
    return vectors.mapInArrow(run, schema)


def digest(books: Codebooks) -> str:
    """SHA-256 of all components in decimal, by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label") -> DataFrame:
    """One row for each vector kept: ``id``, ``code``, ``error``, ``group_error``, ``codebooks_sha256``.

    Vectors that are null, empty or hold null or non-finite components are left out, and so
    are those whose length is not that of the kept vector of least id.  That length must be
    a multiple of ``parts``.  Components times ``scale`` beyond +-2^26 count as +-2^26.
    ``group_error`` sums the errors of all rows of an equal ``group_col``, nulls together.

    With fewer vectors than ``entries`` the codebooks have as many entries as there are
    vectors.  Repeated rows are vectors of their own, and each may be an entry; rows of
    equal id are ordered by their components, null ids come last.  An empty table gives an
    empty result; other columns are not read.
    """
    if entries > 256:
        raise ValueError("an entry's number has two hex digits: at most 256 entries")
    every = stored(integers(rows.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), F.col(vector_col).alias("vec")), "id", "vec", ("group",), scale), "integers")
    lead = every.orderBy(F.col("id").asc_nulls_last(), "ints").select(F.size("ints").alias("n")).first()
    size = lead.n if lead else parts
    if size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    vectors = every.where(F.size("ints") == size)
    books = train(vectors, parts, entries, rounds)
    # Without vectors no row reaches the codebooks.
    told = stored(coded(vectors, books or [np.zeros((1, 1), dtype=np.int64)] * parts).drop("ints"), "codes")
    # Written first, so that the join stands on its own and a group of very many can be split.
    by_group = stored(told.groupBy("group").agg(F.sum("error").alias("group_error")), "group_errors").withColumnRenamed("group", "g")
    out = told.join(by_group, F.col("group").eqNullSafe(F.col("g")))
    return out.select("id", "code", "error", "group_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Both rounds as plain joins of all parts with all entries."""
    near = """n{k} AS (SELECT vec_id, p, x, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
  SELECT m.vec_id, m.p, m.x, b.e, list_sum(list_transform(list_zip(m.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM part m JOIN b{k} b ON b.p = m.p) GROUP BY ALL),"""
    step = """u{k} AS (SELECT p, e, list(c ORDER BY j) AS c FROM (
  SELECT p, e, j, floor(sum(x[j]) / count(*))::BIGINT AS c FROM n{k}, range(1, 5) r(j) GROUP BY p, e, j) GROUP BY p, e),
b{n} AS (SELECT b.p, b.e, coalesce(u.c, b.c) AS c FROM b{k} b LEFT JOIN u{k} u USING (p, e)),"""
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT vec_id, p, ints[p * 4 + 1 : p * 4 + 4] AS x FROM v, range(16) r(p)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v QUALIFY e < 64),
b0 AS (SELECT p, f.e, x AS c FROM part JOIN f USING (vec_id)),
{near.format(k=0)}
{step.format(k=0, n=1)}
{near.format(k=1)}
{step.format(k=1, n=2)}
{near.format(k=2)}
t AS (SELECT vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM n2 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) AS h FROM (SELECT p, e, j, c[j] AS x FROM b2, range(1, 5) r(j)))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM t JOIN v USING (vec_id), h
"""


#: DuckDB SQL of the registered query (64 components).
ORACLE_SQL = _sql()
