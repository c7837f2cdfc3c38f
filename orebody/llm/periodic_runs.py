"""Maximal periodic runs of words in each text, by joining suffix classes in order of their common prefixes.

Suffixes of a text that share a prefix of a given length form a class, an interval of the
suffix array.  As the length falls from the greatest common prefix down, neighbouring
classes are united (Kruskal's order on the edges of the array).  Each class keeps its
positions sorted, and the smaller set is put into the larger one, from its end on.  Two
positions that become neighbours there at distance d, with a common prefix of l >= d words,
are the seed of a stretch of d + l words of period d.  A run of period q that begins at s has its seed at
s and s + q: a position between them would have a shorter period.  So seeds whose first
words are not led by equal words are the runs, each once, and d is their smallest period.

A run that repeats ``times`` times in at least ``least`` words has a seed with a common
prefix of at least ``_gram`` words (16 for 3 and 24).  Only suffixes whose first 16 words occur
again take part, and the joining ends there; most texts have none of them.
Texts are not shuffled, and a text is worked on by one task alone.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let

TIMES, LEAST = 3, 24
#: Positions in a block of a large set.
BLOCK = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)
RUN = "start long, length long, period long"


def _gram(times: int, least: int) -> int:
    """The shortest common prefix that the seed of a run can have."""
    return min(max((times - 1) * q, least - q) for q in range(1, least + 1))


def _repeats(words: list[bytes], width: int) -> bool:
    """Whether some ``width`` words occur twice, by hash: never false where they do."""
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).astype(np.uint64)
    step = 1
    with np.errstate(over="ignore"):
        while step < width:
            h = (h[:-step] * _ODD) ^ (h[:-step] >> np.uint64(29)) ^ (h[step:] * np.uint64(2 * step + 1))
            step *= 2
    order = np.sort(h)
    return bool((order[1:] == order[:-1]).any())


def _suffixes(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that share ``width`` (a power of two) words with another, in order, and how many words each shares with the next.

    Blocks of 1, 2, 4, ... words are named by their order, so equal names are equal words.
    Beyond ``width`` only suffixes that still share a name are told apart.
    """
    n = len(words)
    number: dict[bytes, int] = {}
    rank = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    levels: list[tuple[int, np.ndarray]] = [(1, rank)]
    step = 1
    while step < width:
        pair = rank * (n + 1)
        pair[:-step] += rank[step:] + 1
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        step *= 2
        levels.append((step, rank))
    # From here on a name is the place where its group begins.
    order = np.argsort(rank, kind="stable")
    key = rank[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    begins = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = begins
    many = np.zeros(n, dtype=bool)
    many[1:] |= ~new[1:]
    many[:-1] |= ~new[1:]
    place = np.flatnonzero(many)
    sa, mine, live, group = order[place], place, order[place], begins[place]
    while len(live):
        then = np.where(live + step < n, rank[np.minimum(live + step, n - 1)], -1)
        by = np.lexsort((then, group))
        live, then, group = live[by], then[by], group[by]
        sa[np.searchsorted(mine, place)] = live
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (then[1:] != then[:-1])))
        group = place[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        rank = rank.copy()
        rank[live] = group
        step *= 2
        levels.append((step, rank))
        many = np.zeros(len(live), dtype=bool)
        many[1:] |= ~new[1:]
        many[:-1] |= ~new[1:]
        live, place, group = live[many], place[many], group[many]
    # What neighbours share, from the widest blocks down.
    a, b = sa[:-1].copy(), sa[1:].copy()
    common = np.zeros(len(a), dtype=np.int64)
    for wide, level in reversed(levels):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[level[a[inside]] == level[b[inside]]]
        common[same] += wide
        a[same] += wide
        b[same] += wide
    return sa, common


class _Places:
    """A large set of positions in blocks: a put moves one block only."""

    def __init__(self, sorted_: list[int]) -> None:
        self.blocks = [sorted_[i : i + BLOCK] for i in range(0, len(sorted_), BLOCK)]
        self.first = [b[0] for b in self.blocks]
        self.n = len(sorted_)

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[int]:
        return (x for b in self.blocks for x in b)

    def put(self, x: int) -> tuple[int, int]:
        """Put ``x`` in; its neighbours, -1 where there is none."""
        k = max(bisect_right(self.first, x) - 1, 0)
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else -1
        after = block[i] if i < len(block) else self.first[k + 1] if k + 1 < len(self.first) else -1
        block.insert(i, x)
        self.first[k] = block[0]
        self.n += 1
        if len(block) > 2 * BLOCK:
            self.blocks.insert(k + 1, block[BLOCK:])
            del block[BLOCK:]
            self.first.insert(k + 1, self.blocks[k + 1][0])
        return before, after


def find_runs(words: list[bytes], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, by start, then period."""
    if len(words) < least:
        return []
    gram = _gram(times, least)
    width = 1 << (gram.bit_length() - 1)
    if not _repeats(words, width):
        return []
    sa, common = _suffixes(words, width)
    edges = np.flatnonzero(common >= gram)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    shared = common[edges].tolist()
    parent = list(range(len(sa)))
    sets: list[list[int] | _Places] = [[x] for x in sa.tolist()]
    found = []

    def seed(i: int, j: int, both: int) -> None:
        d = j - i
        if (times - 1) * d <= both and d + both >= least and (i == 0 or words[i - 1] != words[j - 1]):
            found.append((i, d + both, d))

    for t, both in zip(edges.tolist(), shared, strict=True):
        a, b = t, t + 1
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        parent[b] = a
        big, small = sets[a], sets[b]
        sets[b] = []
        if len(big) > 4 * BLOCK and isinstance(big, list):
            big = sets[a] = _Places(big)
        # From the end on: what stands behind a position in its own class is there before it, and no news.
        own = -1
        for x in reversed(list(small)):
            if isinstance(big, list):
                i = bisect_left(big, x)
                before, after = big[i - 1] if i else -1, big[i] if i < len(big) else -1
                big.insert(i, x)
            else:
                before, after = big.put(x)
            if before >= 0:
                seed(before, x, both)
            if after != own:
                seed(x, after, both)
            own = x
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; ties to the least start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run repeats: what it holds behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, times: int = TIMES, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``n_words``, ``n_runs``, ``runs``, ``best``, ``collapsed``.

    Words are what stands between ASCII white space.  ``runs`` are arrays of start (a word's
    number from 0), length and smallest period, by start, then period: every stretch of at
    least ``times`` periods and ``least`` words that no neighbouring word extends.
    ``best`` is the one of greatest length / period (ties: least start, then period), null
    without a run.  ``collapsed`` is the text's words, joined by one blank, without those that
    lie in a run behind its first period.

    A null text counts as empty: no words, no runs, an empty ``collapsed``.  Repeated rows
    stay, null ids stay null, an empty table gives an empty result, other columns are not
    read.  Memory grows with the longest text, at some 300 bytes a word of one that repeats throughout.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    kind = dict(docs.dtypes)[id_col]
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                words = (raw or b"").split()
                runs = find_runs(words, times, least)
                rows.append((len(words), runs, b" ".join(kept_words(words, runs))))
            each = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for _, runs, _ in rows]
            best = [b and dict(zip(("start", "length", "period"), b, strict=True)) for b in (strongest(runs) for _, runs, _ in rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
                 pa.array(each, pa.list_(run_type)), pa.array(best, run_type), pa.array([r[2] for r in rows], pa.binary())],
                names=["id", "n_words", "n_runs", "runs", "best", "collapsed"],
            )

    text = F.col(text_col).cast("string").cast("binary")
    schema = f"id {kind}, n_words long, n_runs long, runs array<struct<{RUN.replace(' ', ':').replace(',:', ',')}>>, best struct<{RUN.replace(' ', ':').replace(',:', ',')}>, collapsed binary"
    found = docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(work, schema)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def runs_text(runs: Column) -> Column:
    """``start,length,period`` of each run, a line each."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")


def planted(text: Column, key: Column) -> Column:
    """``text`` with a repeated tail where the CRC-32 of ``key`` in decimal ends in 0: test data with long periods.

    With h that number, g = h // 10 and n words, each word i >= a = g % n becomes the word
    a + (i - a) % p for p = 1 + (n - a) // (3 + g % 8).  Null or empty texts and null keys stay.
    """
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return let(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p"), w.alias("w")), lambda s: F.array_join(
            F.transform(F.sequence(F.lit(0), F.size(s["w"]) - 1), lambda i: F.get(s["w"], F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]))), " "))

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), let(words, tail)).otherwise(text)
