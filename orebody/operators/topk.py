"""The best documents of every query, found where the documents are.

Query terms go to every task, after their number is checked.  Each task scores the documents
of its own partitions and hands on the ``k`` best of each query, so what is shuffled are
(partitions x queries x k) rows and never a posting: a word that all documents have costs no
row.  Two passes read the stored index: one counts document frequencies and lengths, one scores.

Within a batch each term has a bound, the highest weight that it has there.  Terms of a query
whose bounds together stay below the ``k``-th score so far cannot bring a document in by
themselves; only documents with one of the other terms are scored, and a query whose bounds
all stay below is passed over (the MaxScore rule: Turtle and Flood, "Query evaluation", 1995).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: (query, term) rows that may go to every task, some 30 bytes each; (group, term) statistics; (group, query, k) rows that a task may hold.
MOST_TERMS, MOST_STATISTICS, MOST_HELD = 1_000_000, 1_000_000, 2_000_000
#: Words of a task that are looked at together: some ten arrays of eight bytes each.
PIECE = 1 << 19
#: What rounding of a score can make of it: documents within it of the k-th are scored.
SLACK = 2e-6


@dataclass(frozen=True)
class Asked:
    """Queries as a sparse matrix: query ``q`` has the terms ``term[start[q]:start[q + 1]]``, each ``times`` times."""

    names: list
    terms: pa.Array
    start: np.ndarray
    term: np.ndarray
    times: np.ndarray


@dataclass(frozen=True)
class Statistics:
    """Known statistics: ``frequency`` (term, df), the number of documents, and the mean length of each field."""

    frequency: DataFrame
    n: int
    mean: dict[str, float]


@dataclass(frozen=True)
class Collection:
    """Per group: how many documents have each term, how many there are, and the mean length of each field."""

    df: dict[object, np.ndarray]
    n: dict[object, int]
    mean: dict[object, np.ndarray]


def asked(terms: DataFrame, most: int = MOST_TERMS) -> Asked | None:
    """``terms`` (query, term, qtf) in memory; None if they are more than ``most``."""
    rows = terms.select("query", "term", F.col("qtf").cast("double").alias("qtf")).limit(most + 1).toArrow()
    if rows.num_rows > most:
        return None
    query = rows["query"].combine_chunks().dictionary_encode()
    term = rows["term"].combine_chunks().dictionary_encode()
    at = query.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(at, kind="stable")
    start = np.searchsorted(at[order], np.arange(len(query.dictionary) + 1))
    return Asked(query.dictionary.to_pylist(), term.dictionary, start, term.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order], rows["qtf"].to_numpy()[order])


def _words(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each row of a list column has, and the words of all rows."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """``batches`` cut between rows, so that a piece has about ``most`` words whatever the size of a batch."""
    for batch in batches:
        per, flat = _words(batch.column(batch.schema.get_field_index("fields")))
        ends = np.concatenate([[0], np.cumsum(_words(flat.field("words"))[0])])[np.cumsum(per)] if batch.num_rows else np.zeros(0, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            stop = max(stop, at + 1)
            yield batch.slice(at, stop - at)
            at = stop


def _segments(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, field and length of each text of a batch, and all words in their order."""
    column = batch.column(batch.schema.get_field_index("fields"))
    per, flat = _words(column)
    row = np.repeat(np.arange(batch.num_rows), per)
    field = pc.index_in(flat.field("field"), value_set=pa.array(names, pa.string()))
    field = pc.fill_null(field, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    length, words = _words(flat.field("words"))
    return row, field, length, words


def _groups(batch: pa.RecordBatch) -> tuple[list, np.ndarray]:
    """The groups of a batch, and the number of each row's one."""
    at = batch.schema.get_field_index("grp")
    if at < 0:
        return [None], np.zeros(batch.num_rows, dtype=np.int64)
    found = batch.column(at).dictionary_encode(null_encoding="encode")
    return found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _terms_in(words: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``words`` that are a term, and which."""
    found = pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.flatnonzero(found >= 0)
    return at, found[at]


def _count(terms: pa.Array, names: list[str], empty: bool, kind: pa.DataType | None):
    """Rows (grp, t, n): documents with term t; t = -1: documents (with ``empty`` those without words too); t = -2 - f: words of field f."""

    piece = PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[object, int], int] = {}
        size = max(len(terms), 1)
        for batch in _pieces(batches, piece):
            groups, group = _groups(batch)
            row, field, length, words = _segments(batch, names)
            known = field >= 0
            per_row = np.bincount(row[known], weights=length[known], minlength=batch.num_rows)
            at, t = _terms_in(words, terms)
            of = np.repeat(np.where(known, row, -1), length)[at]
            t, of = t[of >= 0], of[of >= 0]
            pair = np.unique(of * size + t)
            df, n = np.unique(group[pair // size] * size + pair % size, return_counts=True)
            found = [(groups[k // size], k % size, c) for k, c in zip(df.tolist(), n.tolist(), strict=True)]
            some = np.bincount(group[(per_row > 0) | empty], minlength=len(groups))
            found += [(g, -1, c) for g, c in zip(groups, some.tolist(), strict=True)]
            both, of_both = np.unique(group[row[known]] * len(names) + field[known], return_inverse=True)
            sums = np.bincount(of_both, weights=length[known], minlength=len(both)) if len(both) else []
            found += [(groups[k // len(names)], -2 - k % len(names), int(s)) for k, s in zip(both.tolist(), sums, strict=True)]
            for g, t_, c in found:
                total[g, t_] = total.get((g, t_), 0) + c
        keys = list(total)
        columns = [pa.array([t_ for _, t_ in keys], pa.int32()), pa.array(total.values(), pa.int64())]
        if kind is None:
            yield pa.RecordBatch.from_arrays(columns, names=["t", "n"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in keys], kind), *columns], names=["grp", "t", "n"])

    return run


def _half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def _score(held, names: list[str], weights: np.ndarray, k: int, k1: float, b: float, presence: bool, kinds: list[pa.DataType]):
    piece = PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, c = held.value
        size = max(len(q.terms), 1)
        idf = {g: np.log(1 + (c.n[g] - df + 0.5) / (df + 0.5)) for g, df in c.df.items()}
        scale = np.add.reduceat(q.times, q.start[:-1]) if presence and len(q.names) else None
        best: dict[tuple[object, int], list] = {}
        for batch in _pieces(batches, piece):
            groups, group = _groups(batch)
            docs = batch.column(batch.schema.get_field_index("doc")).to_pylist()
            row, field, length, words = _segments(batch, names)
            mean = np.array([c.mean.get(g, np.zeros(len(names))) for g in groups])
            avg = mean[group[row], field] if len(row) else np.zeros(0)
            norm = np.where(avg > 0, 1 - b + b * length / np.where(avg > 0, avg, 1), 1.0)
            part = np.where(field >= 0, weights[field] / norm, 0.0) if len(row) else np.zeros(0)
            at, t = _terms_in(words, q.terms)
            seg = np.repeat(np.arange(len(row)), length)[at]
            t, seg = t[field[seg] >= 0], seg[field[seg] >= 0]
            # Postings by group, term and row.
            key, inv = np.unique((group[row[seg]] * size + t) * batch.num_rows + row[seg], return_inverse=True)
            x = np.bincount(inv, weights=part[seg], minlength=len(key))
            bits = np.zeros(len(key), dtype=np.int64)
            np.bitwise_or.at(bits, inv, np.int64(1) << field[seg])
            rows, slot = key % batch.num_rows if batch.num_rows else key, key // max(batch.num_rows, 1)
            for g, name in enumerate(groups):
                lo, hi = np.searchsorted(slot, (g * size, (g + 1) * size))
                if lo == hi:
                    continue
                t_of = slot[lo:hi] - g * size
                w = np.ones(hi - lo) if presence else idf[name][t_of] * x[lo:hi] * (k1 + 1) / (x[lo:hi] + k1)
                _best_of_batch(q, name, t_of, rows[lo:hi], w, bits[lo:hi], docs, batch.num_rows, k, scale, best)
        out = [(q.names[at_], g, d, s, m) for (g, at_), found in best.items() for s, d, m in found]
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        schema = dict(zip(("query", "grp", "doc", "score", "bits"), (kinds[0], kinds[1], kinds[2], pa.float64(), pa.int64()), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(cols, schema.values(), strict=True)], names=list(schema))

    return run


def _order(found: tuple) -> tuple:
    s, d, _ = found
    return -s, d is not None, 0 if d is None else d


def _best_of_batch(q: Asked, group, term: np.ndarray, rows: np.ndarray, w: np.ndarray, bits: np.ndarray, docs: list, n: int, k: int, scale, best: dict) -> None:
    """Bring into ``best`` what a batch's documents of one group have for each query; postings are sorted by term, then row."""
    size = max(len(q.terms), 1)
    start = np.searchsorted(term, np.arange(size + 1))
    bound = np.zeros(size)
    there = np.flatnonzero(start[1:] > start[:-1])
    bound[there] = np.maximum.reduceat(w, start[there])
    reach = np.add.reduceat(q.times * bound[q.term], q.start[:-1])
    acc, seen = np.zeros(n), np.zeros(n, dtype=bool)
    for at in np.flatnonzero(reach > 0).tolist():
        found = best.get((group, at), [])
        # The k-th score so far, in the unit of the sums.
        least = (found[-1][0] - SLACK) * (scale[at] if scale is not None else 1) if len(found) == k else -math.inf
        if reach[at] < least:
            continue
        mine = slice(q.start[at], q.start[at + 1])
        ts, times = q.term[mine], q.times[mine]
        u = times * bound[ts]
        order = np.argsort(u, kind="stable")
        order = order[u[order] > 0]
        first = int(np.searchsorted(np.cumsum(u[order]), least)) if least > 0 else 0
        for i in order[first:].tolist():
            p = slice(start[ts[i]], start[ts[i] + 1])
            acc[rows[p]] += times[i] * w[p]
            seen[rows[p]] = True
        could = np.flatnonzero(seen)
        for i in order[:first].tolist():
            p = slice(start[ts[i]], start[ts[i] + 1])
            r = rows[p]
            if 8 * len(could) < len(r):
                to = np.searchsorted(r, could)
                to[to == len(r)] = 0
                hit = r[to] == could
                acc[could[hit]] += times[i] * w[p][to[hit]]
            else:
                acc[r] += times[i] * w[p]
        s = acc[could] / scale[at] if scale is not None else acc[could]
        acc[:], seen[:] = 0, False
        s = _half_up(s)
        if len(s) > k:
            enough = s >= np.partition(s, -k)[-k]
            could, s = could[enough], s[enough]
        if len(found) == k:
            enough = s >= found[-1][0]
            could, s = could[enough], s[enough]
        if not len(could):
            continue
        best[group, at] = sorted(found + [(x, docs[r], (r, at)) for x, r in zip(s.tolist(), could.tolist(), strict=True)], key=_order)[:k]
        # Which fields the new ones match, while their postings are at hand.
        new = [i for i, f in enumerate(best[group, at]) if isinstance(f[2], tuple)]
        if new:
            r_new = np.array([best[group, at][i][2][0] for i in new])
            mask = np.zeros(len(new), dtype=np.int64)
            for t in ts.tolist():
                r = rows[start[t] : start[t + 1]]
                if len(r):
                    to = np.minimum(np.searchsorted(r, r_new), len(r) - 1)
                    mask |= np.where(r[to] == r_new, bits[start[t] + to], 0)
            for i, m in zip(new, mask.tolist(), strict=True):
                best[group, at][i] = (*best[group, at][i][:2], m)


def _collection(rows: DataFrame, q: Asked, names: list[str], empty: bool, kind: str | None) -> tuple[dict, dict, dict]:
    """Statistics of the rows of each group, from one pass over them."""
    counted = rows.mapInArrow(_count(q.terms, names, empty, _arrow(kind) if kind else None), f"{f'grp {kind}, ' if kind else ''}t int, n long")
    df: dict[object, np.ndarray] = {}
    n: dict[object, int] = {}
    length: dict[object, np.ndarray] = {}
    for r in counted.groupBy(*(["grp"] if kind else []), "t").agg(F.sum("n").alias("n")).collect():
        g = r.grp if kind else None
        df.setdefault(g, np.zeros(len(q.terms)))
        if r.t >= 0:
            df[g][r.t] = r.n
        elif r.t == -1:
            n[g] = r.n
        else:
            length.setdefault(g, np.zeros(len(names)))[-2 - r.t] = r.n
    return df, n, {g: length.get(g, np.zeros(len(names))) / max(n.get(g, 0), 1) for g in df}


def top_documents(index: DataFrame, terms: DataFrame, k: int, weights: dict[str, float], k1: float = 1.5, b: float = 0.75, within: str | None = None, empty: bool = False, presence: bool = False, statistics: Statistics | None = None) -> DataFrame | None:
    """``query``, ``doc``, ``score``, ``bits``, ``rank`` (with ``within`` that column too), or None where the queries are too many for a task.

    ``index`` is a stored table of ``doc``, ``fields`` (array of struct of field, words) and
    ``within``; ``terms`` has ``query``, ``term``, ``qtf``.  A document's frequency of a term adds up over the
    fields of ``weights``, each by its weight over its length's norm, and is saturated by ``k1``; bit i of
    ``bits`` is set where the i-th of these fields, by name, has a term.  With ``within`` all statistics and
    ranks are those of a value of that column.  ``empty``: documents without words count
    in the collection.  ``presence``: the score is the share of the query's distinct terms instead.
    ``statistics`` that are kept elsewhere save the first pass (not ``within`` groups).

    Scores are rounded half up to six places before they rank; ties go to the lesser ``doc``.
    """
    q = asked(terms.withColumn("qtf", F.lit(1)) if presence else terms)
    if q is None:
        return None
    names = sorted(weights)
    rows = index.select("doc", "fields", *([F.col(within).alias("grp")] if within else []))
    n_groups = rows.select("grp").distinct().limit(MOST_STATISTICS + 1).count() if within else 1
    if n_groups * max(len(q.terms), 1) > MOST_STATISTICS or n_groups * len(q.names) * k > MOST_HELD:
        return None
    kinds = dict(index.dtypes) | {"query": dict(terms.dtypes)["query"]}
    by = ["grp"] if within else []
    if statistics is not None and not within:
        at = {t: i for i, t in enumerate(q.terms.to_pylist())}
        one = np.zeros(len(q.terms))
        # At most one row a query term.
        for r in statistics.frequency.join(terms.select("term").distinct(), "term", "left_semi").collect():
            one[at[r.term]] = r.df
        df, n, mean = {None: one}, {None: statistics.n}, {None: np.array([statistics.mean.get(f, 0.0) for f in names])}
    else:
        df, n, mean = _collection(rows, q, names, empty, kinds[within] if within else None)
    held = index.sparkSession.sparkContext.broadcast((q, Collection(df, n, mean)))
    group_kind = kinds[within] if within else "string"
    schema = f"query {kinds['query']}, grp {group_kind}, doc {kinds['doc']}, score double, bits long"
    arrow = [_arrow(kinds["query"]), _arrow(group_kind), _arrow(kinds["doc"])]
    found = rows.mapInArrow(_score(held, names, np.array([float(weights[f]) for f in names]), max(k, 1), k1, b, presence, arrow), schema)
    order = Window.partitionBy("query", *by).orderBy(F.desc("score"), "doc")
    out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.withColumnRenamed("grp", within) if within else out.drop("grp")


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))
