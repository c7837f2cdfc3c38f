"""Benchmark decontamination by a positional inverted index of the training documents.

A benchmark text is searched by its windows of ``n`` consecutive words.  A phrase query
reads the shortest posting lists first, so the index is asked for each window's two
rarest words only:

1. count the benchmark's words over all documents;
2. pick each window's rarest and second rarest word by these counts;
3. store the postings of the picked words: word, document, position, and the words
   around it;
4. join postings and picked words; position minus offset is where the benchmark text
   would begin, and the two lists intersect where they agree on that beginning;
5. compare the words around the rarest one with the benchmark text: runs of at least
   ``n`` equal words are exact phrase matches.

A document goes by a 128-bit digest of its text, so copies share postings, rows with
the same id stay apart and rows without one take part.

Picked words reach the tasks by a broadcast only where they are at most ``MOST_TERMS``;
more of them are joined to all postings instead.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

WINDOW = 13
#: Words that a broadcast may hold; at 64 bytes each some 30 MB.
MOST_TERMS = 500_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Postings that a task hands on at once.
_BATCH = 50_000


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 ``text``: A-Z lowered, runs of digits, a-z and anything beyond ASCII."""
    return _WORD.findall(text.lower()) if text else []


def _key(text: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(text)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def _text(column: str) -> Column:
    return F.col(column).cast("string").alias("text")


def document_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``key``, ``n_words`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch, 1)
            keys, n = [_key(t) for t in texts], [len(words_of(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(n, pa.int64())], names=["id", "key", "n_words"])

    return docs.select(F.col(id_col).cast("long").alias("id"), _text(text_col)).mapInArrow(run, "id long, key binary, n_words long")


def benchmark_texts(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item``, ``bench`` (digest of the words), ``words`` of each row that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in _texts(batch, 1)]
            arrays = [batch.column(0), pa.array([_key(b" ".join(w)) for w in words], pa.binary()), pa.array([[x.decode() for x in w] for w in words], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["item", "bench", "words"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), _text(text_col))
    return rows.mapInArrow(run, "item string, bench binary, words array<string>").where(F.size("words") > 0)


def _few(terms: DataFrame, most: int):
    """A broadcast set of ``terms`` if they are few enough, else None."""
    found = terms.limit(most + 1).count()
    if found > most:
        return None
    return terms.sparkSession.sparkContext.broadcast(frozenset(r[0].encode() for r in terms.collect()))


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str, most: int = MOST_TERMS) -> DataFrame:
    """``term``, ``n``: how often each of ``terms`` (distinct, one column ``term``) occurs in ``docs``."""
    few = _few(terms, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for text in _texts(batch, 0):
                words = words_of(text)
                seen.update(words if few is None else filter(few.value.__contains__, words))
            yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["term", "n"])

    counts = docs.select(_text(text_col)).mapInArrow(run, "term string, n long")
    if few is None:
        counts = counts.join(terms, "term", "left_semi")
    return counts.groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, terms: DataFrame, text_col: str, around: int = WINDOW - 1, most: int = MOST_TERMS) -> DataFrame:
    """The index: ``term``, ``key``, ``pos``, ``lead``, ``near``, for the occurrences of ``terms`` in ``docs``.

    ``near`` holds the words from ``lead`` before the occurrence to ``around`` after it.
    Copies within a batch are read once.
    """
    few = _few(terms, most)
    names = ["term", "key", "pos", "lead", "near"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            rows: list[tuple] = []
            for text in _texts(batch, 0):
                key = _key(text)
                if key in seen:
                    continue
                seen.add(key)
                words = words_of(text)
                for pos in range(len(words)) if few is None else [i for i, w in enumerate(words) if w in few.value]:
                    lead = min(pos, around)
                    rows.append((words[pos].decode(), key, pos, lead, b" ".join(words[pos - lead : pos + around + 1]).decode()))
                    if len(rows) == _BATCH:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    schema = pa.schema([("term", pa.string()), ("key", pa.binary()), ("pos", pa.int32()), ("lead", pa.int32()), ("near", pa.string())])
    found = docs.select(_text(text_col)).mapInArrow(run, "term string, key binary, pos int, lead int, near string")
    return found if few is not None else found.join(terms, "term", "left_semi")


def rarest(texts: DataFrame, counts: DataFrame, n: int = WINDOW) -> DataFrame:
    """``bench``, ``at``, ``term``, ``rank``: the words that windows of ``texts`` are searched by.

    ``texts`` has distinct ``bench`` and ``words``.  A window with a word that no
    document has cannot occur and picks none.  Ties go to the earlier word.  A word is
    listed once for each rank (1, the rarest; 2) that it has in some window.  Equal windows of
    a text are searched by the first of them, which finds whatever the others would: a text that
    repeats one word picks two places, not all.
    """
    size = F.least(F.size("words"), F.lit(n))
    offsets = F.explode(F.sequence(F.lit(0), F.size("words") - size))
    windows = texts.select("bench", "words", size.alias("size"), offsets.alias("begin"))
    windows = windows.select("bench", "size", "begin", F.slice("words", F.col("begin") + 1, F.col("size")).alias("content"))
    once = windows.groupBy("bench", "size", "content").agg(F.min("begin").alias("begin"))
    cells = once.select("bench", "begin", "size", F.posexplode("content").alias("k", "term"))
    known = cells.join(counts, "term")
    each = Window.partitionBy("bench", "begin")
    ranked = known.withColumn("found", F.count("*").over(each)).where("found = size").withColumn("rank", F.row_number().over(each.orderBy("n", "k")))
    return ranked.where("rank <= 2").select("bench", (F.col("begin") + F.col("k")).alias("at"), "term", "rank").distinct()


def _runs(n: int):
    """Tasks' function: the runs of at least ``n`` equal words of aligned texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                words, low = r["words"], r["low"]
                need, equal = min(n, r["size"]), bytearray(len(words))
                for x in r["seen"]:
                    first = x["at"] - x["lead"] - low
                    for k, w in enumerate(x["near"].split(" ")):
                        if 0 <= first + k < len(words) and words[first + k] == w:
                            equal[first + k] = 1
                for m in re.finditer(rb"\x01{%d,}" % need, bytes(equal)):
                    out.append({"key": r["key"], "bench": r["bench"], "start": r["shift"] + low + m.start(), "stop": r["shift"] + low + m.end()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("key", pa.binary()), ("bench", pa.binary()), ("start", pa.int32()), ("stop", pa.int32())])
    return run


def phrase_matches(index: DataFrame, texts: DataFrame, picked: DataFrame, n: int = WINDOW) -> DataFrame:
    """``key``, ``bench``, ``start``, ``stop``: every maximal run of equal words that holds a window."""
    aligned = index.join(picked, "term").select(
        "key", "bench", (F.col("pos") - F.col("at")).alias("shift"), "rank",
        F.when(F.col("rank") == 1, F.struct("at", "lead", "near")).alias("seen"),
    )
    both = (
        aligned.groupBy("key", "bench", "shift")
        .agg(F.collect_set("seen").alias("seen"), F.max("rank").alias("most"))
        .where(F.size("seen") > 0)
        .join(texts, "bench")
        .where((F.col("most") == 2) | (F.size("words") == 1))
    )
    # Of a long item only the words that the places seen can cover go to Python.
    low = F.greatest(F.array_min(F.transform("seen", lambda x: x["at"] - x["lead"])), F.lit(0))
    high = F.array_max(F.transform("seen", lambda x: x["at"] - x["lead"] + F.size(F.split(x["near"], " "))))
    part = both.withColumn("low", low).withColumn("high", high)
    part = part.select("key", "bench", "shift", "seen", "low", F.size("words").alias("size"), F.slice("words", F.col("low") + 1, F.greatest(F.col("high") - F.col("low"), F.lit(0))).alias("words"))
    return part.mapInArrow(_runs(n), "key binary, bench binary, start int, stop int")


def proximity_matches(index: DataFrame, picked: DataFrame, slop: int = 3) -> DataFrame:
    """``key``, ``bench``, ``begin``, ``off``: places where a rarest and a second rarest word of a text
    occur with their distance off by 1 to ``slop`` words; the least difference of each place.

    ``begin`` is where the text would begin by its rarest word.  Beginnings are dealt
    to bins of ``slop`` + 1, so only neighbouring bins are joined.
    """
    begin = (F.col("pos") - F.col("at")).alias("begin")
    bin_ = F.floor(F.col("begin") / (slop + 1))
    one = index.join(picked.where("rank = 1"), "term").select("key", "bench", begin).distinct().withColumn("bin", bin_)
    two = index.join(picked.where("rank = 2"), "term").select("key", "bench", begin).distinct()
    two = two.select("key", "bench", F.col("begin").alias("other"), F.explode(F.array(bin_ - 1, bin_, bin_ + 1)).alias("bin"))
    off = F.abs(F.col("begin") - F.col("other"))
    return one.join(two, ["key", "bench", "bin"]).where((off >= 1) & (off <= slop)).groupBy("key", "bench", "begin").agg(F.min(off).alias("off"))


def build(docs: DataFrame, benchmark: DataFrame, n: int, id_col: str, text_col: str, item_col: str, item_text: str, most: int = MOST_TERMS):
    """The parts of a search: the index, the benchmark's items, its distinct texts, its picked words."""
    items = stored(benchmark_texts(benchmark, item_col, item_text), "items")
    texts = stored(items.groupBy("bench").agg(F.first("words").alias("words")), "texts")
    terms = texts.select(F.explode("words").alias("term")).distinct()
    picked = stored(rarest(texts, term_counts(docs, terms, text_col, most), n), "picked")
    index = stored(postings(docs, picked.select("term").distinct(), text_col, n - 1, most), "postings")
    return index, items, texts, picked


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = WINDOW,
    share: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    most: int = MOST_TERMS,
) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``key``, ``n_words``, ``n_hit``, ``items``, ``contaminated``.

    A window is ``n`` consecutive words of a benchmark item, or all of an item of fewer.
    ``n_hit`` counts the document's words inside any occurrence of a window, ``items``
    lists the ids (as strings, sorted) of the items whose windows occur, and a document
    is contaminated if ``share`` x n_hit is at least n_words and not zero.

    Null and empty texts have no words on either side and match nothing.  Items without
    an id make hits but have no name to list; repeated items are listed once.  Repeated
    rows and null ids of ``docs`` stay; empty tables give an empty result or no hits.
    """
    index, items, texts, picked = build(docs, benchmark, n, id_col, text_col, item_col, item_text, most)
    runs = stored(phrase_matches(index, texts, picked, n), "runs")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("sum"))

    def add(acc: Column, x: Column) -> Column:
        new = F.greatest(x["stop"] - F.greatest(acc["at"], x["start"]), F.lit(0))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), (acc["sum"] + new).alias("sum"))

    hit = runs.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    hit = hit.select("key", F.aggregate("spans", start, add, lambda acc: acc["sum"]).alias("n_hit"))
    named = runs.select("key", "bench").distinct().join(items.select("bench", "item").distinct(), "bench")
    named = named.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # Written first, so that the join stands on its own and a text with very many copies can be split.
    found = stored(hit.join(named, "key"), "hits")
    rows = document_words(docs, id_col, text_col).join(found, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(
        "id", "key", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the contaminated rows; every other row and column stays as it is."""
    bad = contamination(docs, benchmark, id_col=id_col, text_col=text_col).where("contaminated").select("key").distinct()
    bad = stored(bad, "contaminated")
    import pyspark.sql.types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("__key", T.BinaryType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(text_col).cast(pa.binary()).to_pylist()]
            yield batch.append_column("__key", pa.array([_key(t) for t in texts], pa.binary()))

    marked = docs.mapInArrow(mark, schema)
    return marked.join(bad.withColumnRenamed("key", "__key"), "__key", "left_anti").select(*docs.columns)


#: DuckDB SQL of the registered query, by comparing all windows as strings.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
grams AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
found AS (SELECT r, i, grams.n AS n, item_id FROM grams JOIN win ON grams.gram = win.gram AND grams.n = win.n),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r)
"""
