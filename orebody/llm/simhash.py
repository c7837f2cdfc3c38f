"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint is the bitwise majority of the hashes of a text's word
shingles.  Two fingerprints link if they differ in at most ``radius`` bits.

Covering hashing (Pagh, "Locality-sensitive hashing without false negatives",
2016) gives every bit position i a vector m(i) over GF(2) with radius + 1
entries.  Table v, for each non-zero v, keeps the positions where <m(i), v> = 1.
Up to ``radius`` differing positions leave at least one non-zero v orthogonal to
all their vectors, so each linking pair meets in some table: no link is lost.

Rows that share a bucket are not paired.  Each is dealt to *hubs*: its fingerprint
with up to radius / 2 of the bits that the table ignores flipped.  Members of one
hub are within ``radius`` of each other, and each linking pair of a bucket shares
a hub, so the star from a hub's least member to the others keeps all links.  For
radius 2 a hub has at most 65 members however large a group of copies is.

A near copy may differ in more bits than that.  ``Near`` describes links for near copies: texts
link where the Jaccard similarity of their sets of five-word shingles is at least ``least``, and no
other texts do.  First candidates are texts that share a bucket by one of several fingerprints of single
words (each from the same hashes mixed anew).  A bucket's members are compared with one of
them, chosen by a hash of its own for each fingerprint, so work is linear in a bucket whatever
its size.  A long SimHash of five-word shingles, ``check``, rules most candidates out; the others are
decided by the texts themselves.  This finds most groups at little cost, and loses some links.

With ``whole`` those are found too, and none is lost (``_rest``): two sets over ``least`` share one of their rarest shingles, of
which each gives its first n - least x n + 1 in one order for all (Chaudhuri, Ganti and Kaushik, "A
primitive operator for similarity joins", 2006).  How rare a shingle is, all texts say: every other shingle, by its hash,
that a sample does not show as common is counted (made anew
from the texts for it and not stored, as these are most of all), and those of one group come first.  They make no pair, so
a text a fifth of whose shingles nobody shares meets none, nor does a group of any number of near copies that is known already.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .storage import stored

BITS = 64


@dataclass(frozen=True)
class Near:
    """Links for near copies: fingerprints and words of the candidates, words, 64-bit parts and Jaccard similarity of the check.

    Sets of similarity J have a cosine of 2J / (1 + J) where they are of one size; the bits rule a candidate
    out ``slack`` standard deviations beyond what they say of it.  ``whole``: links that this or the
    buckets lose are found too, so that groups are those of all pairs.
    """

    seeds: int = 6
    shingle: int = 1
    check_shingle: int = 5
    parts: int = 16
    least: float = 0.8
    slack: float = 4.0
    whole: bool = False

    @property
    def most_bits(self) -> int:
        """Bits of the check that a link may differ in."""
        n, p = BITS * self.parts, math.acos(2 * self.least / (1 + self.least)) / math.pi
        return math.floor(n * p + self.slack * math.sqrt(n * p * (1 - p)))


#: Shingles of a text that are hashed before their bits are counted.
CHUNK = 1 << 18


def mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """``hashes`` (unsigned, 64 bits) mixed anew for each ``seed``; seed 0 leaves them as they are."""
    if not seed:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes * np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) % (1 << BITS))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _hashes(words: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the space-joined shingles of ``words``, unsigned, in chunks; fewer words are one shingle, none give none."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    shingle = min(shingle, len(words))
    n = len(words) - shingle + 1 if words else 0
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle))))
        yield np.array([digest(g, 42) for g in grams], dtype="<u8")


def _majority(chunks: Iterable[np.ndarray], seeds: int) -> np.ndarray:
    """For each seed the bits that more than half of the hashes have."""
    n, ones = 0, np.zeros((seeds, BITS), dtype=np.int64)
    for hashes in chunks:
        n += len(hashes)
        for seed in range(seeds):
            bits = np.unpackbits(mixed(hashes, seed).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[seed] += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8").ravel()


def signature(text: bytes, shingle: int = 3, seeds: int = 1) -> np.ndarray:
    """The fingerprints of UTF-8 ``text``, unsigned, one for each seed; zeros where it has no word.

    A-Z are lowered; words are runs of bytes other than \\x20 and \\x09-\\x0D; a
    bit is set where more than half of the XXH64 (seed 42) of the space-joined
    shingles, repeats included, have it.  Texts of fewer words are one shingle.
    """
    return _majority(_hashes(text.lower().split(), shingle), seeds)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The first fingerprint of ``text``; see ``signature``."""
    return int(signature(text, shingle)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id``, ``fp`` (the fingerprint's bits as a signed long) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.array([signature(t.as_py() or b"", shingle)[0] for t in texts], dtype="<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("<i8"))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _text_key(text: bytes) -> bytes:
    """The MD5 of a text, which ``_key_column`` gives too."""
    return hashlib.md5(text, usedforsecurity=False).digest()


def _key_column(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))


def shingles(text: bytes, n: int = 5) -> set[bytes]:
    """The distinct ``n``-word shingles of ``signature``'s words; fewer words are one shingle, none give none."""
    words = text.lower().split()
    if not words:
        return set()
    n = min(n, len(words))
    return set(map(b" ".join, zip(*(words[k:] for k in range(n)))))


def similarity(a: set[bytes], b: set[bytes]) -> float:
    """The Jaccard similarity of two sets; two empty ones are alike."""
    return len(a & b) / len(a | b) if a or b else 1.0


#: Bits of the filter that goes to every task, as a power of two of at most 24.
FILTER = 22


def _place(key: Column) -> Column:
    """The filter's bit of a digest, from its first three bytes."""
    return F.conv(F.hex(F.substring(key, 1, 3)), 16, 10).cast("int").bitwiseAND(F.lit((1 << FILTER) - 1))


def _texts_of(docs: DataFrame, needed: DataFrame, text_col: str) -> DataFrame:
    """``node``, ``text`` for each of ``needed`` (node, key).

    A filter of 2^22 bits by key goes to every task, so that most texts that no pair needs are
    left out before the shuffle.
    """
    bits = np.zeros(1 << FILTER, dtype=bool)
    found = needed.select(_place(F.col("key")).alias("p")).distinct().toArrow()
    bits[found["p"].to_numpy()] = True
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.unpackbits(held.value).astype(bool)
        for batch in batches:
            yield batch.select(["key", "text"]).filter(pa.array(there[batch.column(2).to_numpy()]))

    rows = docs.select(_key_column(text_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("place", _place(F.col("key"))).mapInArrow(some, "key binary, text binary").groupBy("key").agg(F.first("text").alias("text"))
    return rows.join(needed, "key").select("node", "text")


def _verified(pairs: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are similar enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, set()
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if a != last:
                    last, mine = a, shingles(ta, near.check_shingle)
                keep.append(similarity(mine, shingles(tb, near.check_shingle)) >= near.least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    # Written first, so that the joins stand on their own and a text of very many pairs can be split.
    half = stored(pairs.join(two, "b"), "half")
    both = half.join(one, "a").select("a", "b", "text_a", "text_b").sortWithinPartitions("a")
    return both.mapInArrow(work, "a long, b long")


#: Texts whose shingles are counted, and shingles of them that are told to every task as common ones.
COUNTED, COMMON = 10_000, 200_000
#: Times that the texts of a shingle meet one of them before they meet each other.
ROUNDS = 2


def _distinct(hashes: Iterable[np.ndarray]) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; a text without words has one of its own."""
    found = list(hashes)
    return np.unique(np.concatenate(found)) if found else np.zeros(1, dtype="<u8")


def _longs(rows: list[np.ndarray]) -> pa.Array:
    """Lists of unsigned hashes as signed longs."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).view("<i8") if rows else np.array([], dtype="<i8")))


def _common(docs: DataFrame, near: Near, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of some 10,000 texts have, sorted, and how many have each.

    They only put shingles in order, the common ones last: any order gives the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                found = _distinct(_hashes((t.as_py() or b"").lower().split(), near.check_shingle))
                yield pa.RecordBatch.from_arrays([pa.array(found.view("<i8"))], names=["s"])

    text = F.col(text_col).cast("string").alias("text")
    share = max(docs.count() // COUNTED, 1)
    some = docs.select(text).where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).distinct().mapInArrow(run, "s long")
    n = some.groupBy("s").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "s").limit(COMMON).toArrow()
    s = n["s"].to_numpy().view("<u8")
    order = np.argsort(s)
    return s[order], n["n"].to_numpy()[order]


def _length(n, least: float):
    """How many of a set's ``n`` shingles any set over ``least`` shares one of."""
    return n - F.ceil(n * least - 1e-6) + 1 if isinstance(n, Column) else n - math.ceil(least * n - 1e-6) + 1


def _first(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """A set's shingles to be counted, and as many others in the order of the sample as are then left to ``_length``."""
    known, count = common
    n = np.zeros(len(shingles), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        n = np.where(known[at] == shingles, count[at], 0)
    counted = (n == 0) & (shingles % np.uint64(2) == 0)
    rest, n = shingles[~counted], n[~counted]
    more = max(_length(len(shingles), least) - int(counted.sum()), 0)
    return shingles[counted], rest[np.lexsort((rest, n))][:more]


def _short(key: bytes) -> int:
    """32 bits of a text's digest, signed."""
    return int.from_bytes(key[:4], "little", signed=True)


def _counted(docs: DataFrame, common, near: Near, text_col: str) -> DataFrame:
    """``s``, ``h``: 48 bits of each shingle to be counted, and ``_short`` of a text that has it; once for each text of a task.

    These are most of all shingles, so they are made anew from the texts and shuffled as few bytes, and never stored.
    Fewer bits let some shingles or texts look alike: that adds candidates and loses none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, found, of = set(), [], []

        def rows() -> pa.RecordBatch:
            s = (np.concatenate(found) >> np.uint64(16)).view("<i8")
            return pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.repeat(np.array(of, dtype=np.int32), [len(x) for x in found]))], names=["s", "h"])

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                text = t.as_py() or b""
                key = _text_key(text)
                if key in seen:
                    continue
                seen.add(key)
                found.append(_first(_distinct(_hashes(text.lower().split(), near.check_shingle)), common.value, near.least)[0])
                of.append(_short(key))
                if len(found) == 1000:
                    yield rows()
                    found, of = [], []
        if found:
            yield rows()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "s long, h int")


def _odd(shingles: np.ndarray) -> np.ndarray:
    """Which of 2 to 4 bits a shingle (up to 2^15 in all) an odd number of the set's shingles have.

    Two sets differ in at least as many shingles as such bits.
    """
    size = min(max(1 << (2 * len(shingles) - 1).bit_length(), BITS), 1 << 15)
    odd = np.bincount((shingles % np.uint64(size)).astype(np.int64), minlength=size) % 2
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def _differ(a: Column, b: Column) -> Column:
    """Differing bits of two sets of ``_odd``, one folded where it is twice as long as the other."""
    k = F.least(F.size(a), F.size(b))
    xor = lambda x, y: x.bitwiseXOR(y)
    folded = lambda x: F.when(F.size(x) == 2 * k, F.zip_with(F.slice(x, F.lit(1), k), F.slice(x, k + 1, k), xor)).otherwise(x)
    n = F.aggregate(F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda s, x: s + x)
    return F.when(F.greatest(F.size(a), F.size(b)) <= 2 * k, n).otherwise(0)


def near_signatures(docs: DataFrame, near: Near, common=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``key`` (digest of the text), ``h`` (see ``_short``), ``fps``, ``check`` (arrays of bits), ``n`` (distinct shingles), ``counted`` (how many are counted), ``others`` (see ``_first``), ``odd`` (see ``_odd``) for each row of ``docs``.

    Bits and shingles are signed longs; without ``common`` (a broadcast of ``_common``) the last three are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
            keys = [_text_key(t) for t in texts]
            fps, check, n, counted, others, odd = [], [], [], [], [], []
            for t in texts:
                words = t.lower().split()
                fps.append(_majority(_hashes(words, near.shingle), near.seeds))
                hashes = list(_hashes(words, near.check_shingle))
                check.append(_majority(hashes, near.parts))
                found = _distinct(hashes)
                n.append(len(found))
                mine, rest = _first(found, common.value, near.least) if common else (found[:0], found[:0])
                counted.append(len(mine))
                others.append(rest)
                odd.append(_odd(found) if common else found[:0])
            columns = [pa.array(keys, pa.binary()), pa.array(map(_short, keys), pa.int32()), _longs(fps), _longs(check), pa.array(n, pa.int32()), pa.array(counted, pa.int32()), _longs(others), _longs(odd)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "key", "h", "fps", "check", "n", "counted", "others", "odd"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, key binary, h int, fps array<bigint>, check array<bigint>, n int, counted int, others array<bigint>, odd array<bigint>")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def covering_masks(radius: int = 2) -> list[int]:
    """Masks, as unsigned, such that any two words within ``radius`` agree under one of them."""
    size = (1 << (radius + 1)) - 1
    vectors = [1 + i % size for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size + 1)]


def _flips(mask: int, most: int) -> list[int]:
    """All ways, none included, to flip up to ``most`` bits outside ``mask``."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [_signed(sum(1 << i for i in bits)) for k in range(most + 1) for bits in combinations(free, k)]


def _keys(masks: list[int]):
    """Column: the table and the kept bits of ``fp`` for each of ``masks``."""
    return F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "bits")


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``a``, ``b`` that connect the distinct longs of ``fp`` as links within ``radius`` do.

    Every edge is a link; not every link is an edge, but its ends are connected.
    ``radius`` is even.  Nulls take no part.
    """
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even and not negative")
    masks = covering_masks(radius)
    keys = fps.where("fp is not null").select("fp", _keys(masks))
    # Written first, so that the join stands on its own and a bucket of very many can be split.
    shared = stored(keys.groupBy("t", "bits").agg(F.count("*").alias("n")).where("n > 1").select("t", "bits"), "shared")
    flips = F.array(*[F.array(*[F.lit(x) for x in _flips(m, radius // 2)]) for m in masks])
    hubs = (
        keys.join(shared, ["t", "bits"])
        .select("fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    )
    stars = hubs.groupBy("hub").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    return (
        stars.select(F.array_min("members").alias("b"), F.explode("members").alias("a")).where("a <> b").select("a", "b").distinct()
    )


def _named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (node, low, ...) without ``low`` and with ``component``: the least ``low`` reachable over ``edges``; stored."""
    found = connected_components(edges).withColumnRenamed("node", "n")
    named = nodes.join(found, nodes.node == F.col("n"), "left").drop("n").withColumn("label", F.coalesce("component", "node")).drop("component")
    lows = stored(named.where(F.col("low").isNotNull()).groupBy("label").agg(F.min("low").alias("component")), "lows")
    return stored(named.join(lows, "label", "left").drop("label", "low"), "names")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``fp``, ``component``, the least id reachable over links.

    A null or empty text has fingerprint zero and links as others do.  A row with
    a null id is returned and connects others, but never names a component; a
    component without any id has a null name.  Repeated rows stay repeated.  Other
    columns of ``docs`` are not read.
    """
    sig = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(sig.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    names = _named(distinct.withColumn("node", F.col("fp")), fingerprint_links(distinct, radius))
    return sig.join(names, "fp").select("id", "fp", "component")


def _labelled(nodes: DataFrame, edges: DataFrame, name: str = "node") -> DataFrame:
    """``nodes`` with ``label``: the least of column ``name`` reachable over ``edges``."""
    found = connected_components(edges).select(F.col("node").alias(name), "component")
    joined = nodes.join(found, name, "left").withColumn("now", F.coalesce("component", name))
    return joined.drop("component", "label").withColumnRenamed("now", "label")


def _rest(docs: DataFrame, nodes: DataFrame, edges: DataFrame, near: Near, common, text_col: str) -> DataFrame:
    """Links (a, b) between ``nodes`` (node, key, h, n, counted, others, odd) that ``edges`` do not connect: all that their groups need.

    Texts that share one of their first shingles are looked at by that shingle.  ``ROUNDS`` times each meets one of
    the shingle's texts, so that large groups grow together; then all of other groups that are left meet each other.
    """

    def shared(rows: DataFrame) -> DataFrame:
        by = Window.partitionBy("s")
        return rows.withColumn("lo", F.min("label").over(by)).withColumn("hi", F.max("label").over(by)).where("lo <> hi").drop("lo", "hi")

    def apart(rows: DataFrame) -> DataFrame:
        return stored(shared(rows), "live")

    def rarest(named: DataFrame) -> DataFrame:
        """Of each text's shingles that groups share those among its first, with the place ``at``: after all counted ones that no other group has."""
        often = _counted(docs, common, near, text_col).withColumn("df", F.count("*").over(Window.partitionBy("s"))).where("df > 1")
        mine = stored(often, "often").join(named.select("h", "node", "label", "n", "counted"), "h").select("node", "label", "n", "counted", F.lit(None).cast("int").alias("i"), "s", "df")
        others = named.select("node", "label", "n", "counted", F.posexplode("others").alias("i", "s"), F.lit(0).cast("long").alias("df"))
        held = stored(shared(mine.unionByName(others)), "shared").withColumn("mine", F.col("i").isNull())
        of = Window.partitionBy("node", "mine")
        place = F.col("counted") - F.count("*").over(of) + F.row_number().over(of.orderBy("df", "s")) - 1
        placed = held.withColumn("at", F.when(F.col("mine"), place).otherwise(F.col("counted") + F.col("i")))
        return placed.where(F.col("at") < _length(F.col("n"), near.least)).select("node", "label", "n", F.col("at").cast("int").alias("at"), "s")

    def met(live: DataFrame, one: DataFrame, once: Column | None = None) -> DataFrame:
        two = one.select("s", *[F.col(c).alias(f"{c}2") for c in ("node", "label", "n", "at")])
        # Of a pair's shared shingles the first has all others behind it.
        most = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
        could = most * (1 + near.least) >= near.least * (F.col("n") + F.col("n2")) - 1e-6
        pairs = live.join(two, "s").where((F.col("label") != F.col("label2")) & could & (F.lit(True) if once is None else once))
        low = F.col("node") < F.col("node2")
        ends = [F.when(low, F.col(f"{c}2")).otherwise(F.col(c)) for c in ("node", "label")], [F.when(low, F.col(c)).otherwise(F.col(f"{c}2")) for c in ("node", "label")]
        return pairs.select(ends[0][0].alias("a"), ends[1][0].alias("b"), ends[0][1].alias("x"), ends[1][1].alias("y")).distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        one, two = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}")) for x in "ab")
        # Sets over the least differ in few shingles: exact, and few texts that do not link are left.
        few = _differ(F.col("odd_a"), F.col("odd_b")) * (1 + near.least) <= (1 - near.least) * (F.col("n_a") + F.col("n_b")) + 1e-6
        pairs = stored(stored(pairs, "met").join(one, "a").join(two, "b").where(few).select("a", "b", "x", "y"), "few")
        needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "key"), "node")
        texts = stored(_texts_of(docs, stored(needed, "needed"), text_col), "texts")
        return stored(_verified(pairs.select("a", "b"), texts, near).join(pairs, ["a", "b"]), "rest")

    named = _labelled(nodes.select("node", "h", "n", "counted", "others"), edges)
    live = apart(rarest(stored(named, "named")))
    found = edges.limit(0)
    for salt in range(ROUNDS):
        one = live.groupBy("s").agg(F.min_by(F.struct("node", "label", "n", "at"), F.xxhash64("node", "s", F.lit(salt))).alias("one"))
        links = linked(met(live, stored(one.select("s", "one.*"), "one")))
        found = found.unionByName(links.select("a", "b"))
        live = apart(_labelled(live, links.select(F.col("x").alias("a"), F.col("y").alias("b")), "label"))
    return found.unionByName(linked(met(live, live, F.col("node") < F.col("node2"))).select("a", "b"))


def near_groups(docs: DataFrame, near: Near, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``key`` (digest of the text), ``component``, the least id reachable over links of ``near``.

    Nulls, empty texts and repeated rows are treated as by ``simhash_groups``.
    """
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, near, text_col)) if near.whole else None
    sig = stored(near_signatures(docs, near, common, id_col, text_col), "signatures")
    nodes = sig.groupBy("key").agg(F.min("id").alias("low"), *[F.first(c).alias(c) for c in ("h", "fps", "check", "n", "counted", "others", "odd")])
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = nodes.select("node", F.xxhash64("key").alias("h"), F.posexplode("fps").alias("seed", "fp")).select("node", "h", "seed", _keys(covering_masks(radius)))
    # Chosen by the text, not by the node's number, which another run may deal otherwise.
    chosen = keys.groupBy("seed", "t", "bits").agg(F.min_by("node", F.xxhash64("h", "seed")).alias("one"), F.count("*").alias("n"))
    chosen = stored(chosen.where("n > 1").select("seed", "t", "bits", "one"), "chosen")
    met = keys.join(chosen, ["seed", "t", "bits"]).where("node <> one").select(F.greatest("node", "one").alias("a"), F.least("node", "one").alias("b")).distinct()
    one, two = (nodes.select(F.col("node").alias(x), F.col("check").alias(f"check_{x}")) for x in "ab")
    off = F.aggregate(F.zip_with("check_a", "check_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    pairs = stored(met.join(one, "a").join(two, "b").where(off <= near.most_bits).select("a", "b"), "pairs")
    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "key"), "node"), "needed")
    edges = stored(_verified(pairs, stored(_texts_of(docs, needed, text_col), "texts"), near), "edges")
    if near.whole:
        edges = edges.unionByName(_rest(docs, nodes, edges, near, common, text_col))
    names = _named(nodes.select("node", "low", "key"), edges)
    return sig.select("id", "key").join(names.select("key", "component"), "key")


def fingerprint_hex(fp):
    """Column: 16 lower-case hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, near: Near | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names its component: one document of each group.

    Groups are those of ``simhash_groups``, or with ``near`` those of ``near_groups``.
    Rows that repeat an id are one document, of which the row of the least text stays.
    Rows without an id cannot be told from copies by name; they stay unless their group has
    a document with an id, and copies among them are reduced to one by their text.
    """
    if near:
        groups = near_groups(docs, near, id_col, text_col)
    else:
        groups = simhash_groups(docs, id_col, text_col).withColumnRenamed("fp", "key")
    groups = stored(groups, "groups")
    ids = groups.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.max(F.expr("id = component")).alias("keep"))
    ids = stored(ids.where("keep").select(F.col("id").alias("__id"), "n"), "kept")
    # The same plan at every size: kept ids grow with the documents, so both sides are dealt by id.
    named = docs.join(ids.where("n = 1").hint("merge"), F.col(id_col) == F.col("__id"), "left_semi")
    row = F.struct(*docs.columns)
    twice = docs.join(ids.where("n > 1"), F.col(id_col) == F.col("__id"), "left_semi").groupBy(F.col(id_col).alias("__id"))
    twice = twice.agg(F.min_by(row, F.struct(F.col(text_col), F.to_json(row))).alias("__row")).select("__row.*")
    lone = groups.where("id is null and component is null").select(F.col("key").alias("__key")).distinct()
    return named.unionByName(twice).unionByName(_unnamed(docs, lone, id_col, text_col, near is not None))


def _unnamed(docs: DataFrame, lone: DataFrame, id_col: str, text_col: str, by_text: bool) -> DataFrame:
    """Of the rows without an id those that no document with an id stands for, one for each text."""
    rows = docs.where(F.col(id_col).isNull())
    schema = T.StructType([*rows.schema.fields, T.StructField("__key", T.BinaryType() if by_text else T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(text_col).cast(pa.binary())]
            if by_text:
                keys = pa.array([_text_key(t) for t in texts], pa.binary())
            else:
                keys = pa.array([int(signature(t).view("<i8")[0]) for t in texts], pa.int64())
            yield batch.append_column("__key", keys)

    return rows.mapInArrow(run, schema).join(lone, "__key", "left_semi").dropDuplicates([text_col]).drop("__key")
