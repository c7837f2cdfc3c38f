"""Byte-level BPE by merge replay over the distinct words of a corpus, and decoding.

The words that most parts of the corpus have, at most ``HEAD`` of at most ``WORD`` characters,
are told apart once for the whole corpus, and each partition of their table replays the
merges over all its words at once.  An inverted index leads from a merge (the pairs of
tokens that give one token) to the places where it can be applied; merges are taken in rank
order, places from left to right, and each one touches its two neighbours only
(``Ranks.replay``).  The result is stored as a lexicon of words and their ids, which goes to
every task, as its bound does not grow with the corpus.

Texts are not shuffled.  A word that the lexicon lacks is replayed where its text is, with
all others of some million characters, by the same code: the bound changes no result.

A text is cut before each blank that stands before anything but white space: the pattern
always begins a new piece there.  What lies between is a word and may hold several pieces.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .token_counts import _slices

#: Words that go to every task, characters of the longest of them, and bytes that are replayed at once.
HEAD, WORD, REPLAY_BYTES = 200_000, 64, 1_000_000
#: Characters of text that are encoded at once.
SLICE = 2_000_000
#: Places of a merge from which on arrays are quicker than a loop.
BULK = 200

#: The pattern of the rank files' documentation, by classes that Python's own ``re`` has; see ``_odd``.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_IRREGULAR = re.compile(r" (?!\S)")
_CUT = re.compile(r" (?=\S)")


@functools.cache
def _odd() -> tuple[re.Pattern, dict[int, str]]:
    """Characters that ``re`` and the tokenizer's library class differently, and for each a character that both class as the library does.

    The library is asked: an encoding whose pattern is one class drops all other characters.
    """
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    marks: dict[int, str] = {}
    for theirs, ours, mark in ((r"\p{L}", r"[^\W\d_]", "é"), (r"\p{N}", r"\d", "7"), (r"\s", r"\s", " "), (r"[^\s\p{L}\p{N}]", r"[^\s\w]|_", "!")):
        enc = tiktoken.Encoding("class", pat_str=theirs, mergeable_ranks=single, special_tokens={})
        theirs_set = set(enc.decode_bytes(enc.encode_ordinary(every)).decode())
        marks |= {ord(c): mark for c in theirs_set - set(re.findall(ours, every))}
    span: list[list[int]] = []
    for c in sorted(marks):
        if span and span[-1][1] == c - 1:
            span[-1][1] = c
        else:
            span.append([c, c])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in span) + "]"), marks


def pieces(text: str) -> list[str]:
    """The matches of the pattern in ``text``, which together are ``text``."""
    odd, marks = _odd()
    if odd.search(text):
        return [text[m.start() : m.end()] for m in _PIECE.finditer(text.translate(marks))]
    return _PIECE.findall(text)


def words(text: str) -> list[str]:
    """``text`` cut into words; all but the first begin with a blank, which is left out."""
    return _CUT.split(text) if _IRREGULAR.search(text) else text.split(" ")


class Ranks:
    """The tokens of a rank file (base64 of the bytes, rank, one a line); a token's id is its rank."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._single = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self._first = np.array([self.ranks.get(bytes([i, j]), -1) for i in range(256) for j in range(256)], dtype=np.int32)
        # Every pair of tokens that is a token: the only merges there are.
        self._merge = {self.ranks[b[:i]] << 32 | self.ranks[b[i:]]: r for b, r in self.ranks.items() for i in range(1, len(b)) if b[:i] in self.ranks and b[i:] in self.ranks}
        keys = np.array(sorted(self._merge), dtype=np.int64)
        self._keys = np.append(keys, np.iinfo(np.int64).max)
        self._to = np.array([self._merge[k] for k in keys.tolist()] + [-1], dtype=np.int32)

    def encode_words(self, some: Iterable[str], blank: bool = True) -> dict[str, bytes]:
        """The ids of each distinct word, as little-endian unsigned 32-bit integers; with ``blank`` of the word after a blank."""
        out: dict[str, bytes] = {}
        for part in _slices(list(some), REPLAY_BYTES):
            out.update(self._some(part, blank))
        return out

    def _some(self, some: list[str], blank: bool) -> Iterator[tuple[str, bytes]]:
        if blank:  # one text of all words has the pieces of each, as every blank before a word begins one
            flat = pieces(" " + " ".join(some))
            ends = np.cumsum([len(w) + 1 for w in some])
            stops = np.searchsorted(np.cumsum([len(p) for p in flat]), ends) + 1
        else:
            each = [pieces(w) for w in some]
            flat = [p for ps in each for p in ps]
            stops = np.cumsum([len(ps) for ps in each])
        raw = {p: p.encode() for p in set(flat)}
        ids = {p: self.ranks[b].to_bytes(4, "little") for p, b in raw.items() if b in self.ranks}
        todo = [p for p in raw if p not in ids]
        ids.update(zip(todo, self.replay([raw[p] for p in todo]), strict=True))
        coded = [ids[p] for p in flat]
        stops = stops.tolist() if len(some) else []
        for w, a, b in zip(some, [0, *stops], stops):
            yield w, coded[a] if b - a == 1 else b"".join(coded[a:b])

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The tokens that pairs merge to, -1 where there is none."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._to[at], -1)

    def replay(self, some: list[bytes]) -> list[bytes]:
        """The ids of each piece: every merge in rank order over all pieces at once.

        ``at[r]`` holds the places where a pair merges to token ``r``.  A place whose pair
        has changed since is passed over.  Should a merge make one of lower rank possible,
        that one comes first, as it would in a piece by itself.
        """
        if not some:
            return []
        raw = np.frombuffer(b"".join(some), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in some])
        n = len(raw)
        merge = np.full(n, -1, dtype=np.int32)
        merge[:-1] = self._first[raw[:-1].astype(np.int32) * 256 + raw[1:]]
        merge[ends - 1] = -1
        after, before = np.arange(1, n + 1, dtype=np.int64), np.arange(-1, n - 1, dtype=np.int64)
        after[ends - 1] = -1
        before[np.concatenate(([0], ends[:-1]))] = -1
        order = np.argsort(merge, kind="stable")
        order = order[np.searchsorted(merge[order], 0) :]
        cuts = np.flatnonzero(np.diff(merge[order])) + 1
        at = {int(merge[p[0]]): p.tolist() for p in np.split(order, cuts) if len(p)}
        heap = list(at)
        heapq.heapify(heap)
        tok, pr = array("i", self._single[raw].tobytes()), array("i", merge.tobytes())
        nxt, prv = array("q", after.tobytes()), array("q", before.tobytes())
        alive = bytearray(b"\1") * n
        views = [np.frombuffer(x, dtype=d) for x, d in ((tok, np.int32), (pr, np.int32), (nxt, np.int64), (prv, np.int64), (alive, np.uint8))]
        known, push = self._merge.get, heapq.heappush
        while heap:
            r = heapq.heappop(heap)
            places = at.pop(r)
            if len(places) >= BULK and self._bulk(r, places, views, at, heap):
                continue
            if len(places) > 1:
                places.sort()
            for k, i in enumerate(places):
                if pr[i] != r:
                    continue
                j = nxt[i]
                tok[i], pr[j], alive[j], pr[i] = r, -1, 0, -1
                right, left = nxt[j], prv[i]
                nxt[i] = right
                if right >= 0:
                    prv[right] = i
                    b = tok[right]
                    new = known(r << 32 | b, -1)
                    pr[i] = new
                    if new >= 0:
                        if new in at:
                            at[new].append(i)
                        else:
                            at[new] = [i]
                            push(heap, new)
                if left >= 0:
                    a = tok[left]
                    new = known(a << 32 | r, -1)
                    pr[left] = new
                    if new >= 0:
                        if new in at:
                            at[new].append(left)
                        else:
                            at[new] = [left]
                            push(heap, new)
                if heap and heap[0] < r and k + 1 < len(places):
                    at[r] = places[k + 1 :] + at.get(r, [])
                    push(heap, r)
                    break
        live = np.frombuffer(alive, dtype=np.uint8)
        ids = np.frombuffer(tok, dtype=np.int32)[live == 1].astype("<u4").tobytes()
        stops = (np.cumsum(live, dtype=np.int64)[ends - 1] * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def _bulk(self, r: int, places: list[int], views: list[np.ndarray], at: dict[int, list[int]], heap: list[int]) -> bool:
        """All merges to ``r`` as array operations; False, with nothing changed, where their order matters.

        It does where one merge takes what another would begin with, or makes a lower rank possible.
        """
        tok, pr, nxt, prv, alive = views
        p = np.unique(np.array(places, dtype=np.int64))
        p = p[pr[p] == r]
        j = nxt[p]
        if not len(p):
            return True
        if (pr[j] == r).any():
            return False
        right, was = nxt[j], tok[p].copy()
        inner = right >= 0
        # Between two merges side by side the left one's token stands before what the right one begins with.
        beside = right[inner][pr[right[inner]] == r]
        if len(beside):
            between = self._ranks(np.full(len(beside), r), tok[beside])
            if ((between >= 0) & (between < r)).any():
                return False
        tok[p], nxt[p] = r, right
        prv[right[inner]] = p[inner]
        left = prv[p]
        x = np.unique(np.concatenate((p[inner], left[left >= 0])))
        new = self._ranks(tok[x], tok[nxt[x]])
        if ((new >= 0) & (new < r)).any():
            tok[p], nxt[p] = was, j
            prv[right[inner]] = j[inner]
            return False
        pr[j], pr[p], alive[j] = -1, -1, 0
        pr[x] = new
        some = np.flatnonzero(new >= 0)
        some = some[np.argsort(new[some], kind="stable")]
        key, starts = np.unique(new[some], return_index=True)
        for q, part in zip(key.tolist(), np.split(x[some], starts[1:])):
            if q in at:
                at[q] += part.tolist()
            else:
                at[q] = part.tolist()
                heapq.heappush(heap, q)
        return True

    def encode(self, texts: list[str], lexicon: dict[str, bytes]) -> list[bytes]:
        """The ids of each text, by ``lexicon`` and, for words that it lacks, by a replay over those of all ``texts``."""
        cut = [words(t) for t in texts]
        first = self.encode_words({c[0] for c in cut}, blank=False)
        rest = self.encode_words(set().union(*(c[1:] for c in cut)).difference(lexicon)) if cut else {}
        get = lexicon.get
        out = []
        for c in cut:
            now = [first[c[0]]]
            now += [get(w) or rest[w] for w in c[1:]]
            out.append(b"".join(now))
        return out


@functools.lru_cache(maxsize=2)
def _ranks(path: str) -> Ranks:
    return Ranks(path)


@functools.lru_cache(maxsize=2)
def _bytes_of(path: str) -> dict[int, bytes]:
    with open(path, "rb") as f:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}


def _parts(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """``column`` in pieces of about ``size`` bytes, with the row at which each begins: only one is held as Python objects."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")), at + 1)
        yield at, column.slice(at, to - at)
        at = to


def _texts(column: pa.Array) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in column.to_pylist()]


def _some_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(found: set[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["word"])

    found: set[str] = set()
    held = 0
    for batch in batches:
        for text in (t for _, part in _parts(batch.column(0)) for t in _texts(part)):
            found.update(w for w in set(words(text)[1:]).difference(found) if len(w) <= WORD)
            held += len(text)
            # Parts of a bounded length: a task's distinct words need not fit into memory.
            if held >= 32_000_000 or len(found) > 250_000:
                yield out(found)
                found, held = set(), 0
    yield out(found)


def lexicon(docs: DataFrame, ranks: str, text_col: str = "text", least: int = 2, most: int = HEAD) -> DataFrame:
    """``word``, ``parts``, ``ids`` of the ``most`` distinct words that most parts of the corpus have, ties by the word; stored.

    Words have up to ``WORD`` characters and stand after a blank in ``least`` parts of the corpus;
    ``parts`` counts these, ``ids`` are those of the word with its blank.  ``ranks`` is a rank file
    that every executor has.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _ranks(ranks).encode_words(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.values(), pa.binary())], names=["word", "parts", "ids"])

    some = docs.select(F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(_some_words, "word string")
    each = some.groupBy("word").agg(F.count("*").alias("parts")).where(F.col("parts") >= least)
    top = each.orderBy(F.desc("parts"), "word").limit(most).repartition("word")
    return stored(top.mapInArrow(encode, "word string, parts long, ids binary"), "lexicon")


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", words_of: DataFrame | None = None, head: int = HEAD) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``ids`` (little-endian unsigned 32-bit integers).

    Whole texts are encoded as the library encodes ordinary text: no special tokens, each
    match of the pattern by itself.  ``words_of`` is a ``lexicon`` made before, of any texts.

    A null text counts as empty and gives no ids; bytes that are not UTF-8 count as the
    replacement character.  Repeated rows stay, null ids stay null, an empty table gives an
    empty result, other columns are not read.  A task holds the words of some million
    characters, or of one text, and some 60 bytes for each byte of the longest single match.
    """
    spark = docs.sparkSession
    words_of = lexicon(docs, ranks, text_col, most=head) if words_of is None else words_of
    # At most ``head`` words of at most WORD characters: a bound that does not grow with the corpus.
    most = words_of.orderBy(F.desc("parts"), "word").limit(head).select("word", "ids").toArrow()
    known = spark.sparkContext.broadcast((most.column(0).combine_chunks(), most.column(1).combine_chunks()))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _ranks(ranks)
        held = dict(zip(known.value[0].to_pylist(), known.value[1].to_pylist(), strict=True))
        for batch in batches:
            for at, part in _parts(batch.column(1)):
                ids = table.encode(_texts(part), held)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(ids, pa.binary())], names=["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, f"id {kind}, ids binary")


def decoded(ids: bytes, table: dict[int, bytes]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def decode(coded: DataFrame, ranks: str, ids_col: str = "ids") -> DataFrame:
    """``coded`` with ``bytes``: what its ids stand for; null ids give null.  An id that the file lacks raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bytes_of(ranks)
        for batch in batches:
            for at, part in _parts(batch.column(batch.schema.get_field_index(ids_col))):
                raw = [None if x is None else decoded(x, table) for x in part.to_pylist()]
                some = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, "bytes"])

    schema = coded.drop("bytes").schema
    return coded.drop("bytes").mapInArrow(run, schema.add("bytes", "binary"))
