"""Retrieval over tables of queries: lexical, field-weighted, vector, fused; look-ups and routing.

Every operator answers a whole table of queries.  Scores are rounded before they rank, so
that the order of a shuffle cannot change a result; ties go to the lesser identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import overlap, tokens
from ..session import stored
from . import cells
from .index import document_frequency, index_collection, index_postings, term_index
from .topk import Statistics, top_documents


def top(scored: DataFrame, k: int, by: str = "query", score: str = "score", tie: str = "doc") -> DataFrame:
    """The ``k`` best rows of each ``by`` with their ``rank``; none where ``k`` is not positive."""
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, id_col: str = "query", text_col: str = "text") -> DataFrame:
    """``query``, ``term``, ``qtf``."""
    words = queries.select(F.col(id_col).alias("query"), F.explode(tokens(F.col(text_col))).alias("term"))
    return words.groupBy("query", "term").agg(F.count("*").alias("qtf"))


def _bm25(tf: Column, length: Column, df: Column, n: Column, avg_len: Column, k1: float, b: float) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text", within: str | None = None, index: DataFrame | None = None, statistics: Statistics | None = None) -> DataFrame:
    """``query``, ``doc``, ``score``, ``rank`` by BM25; with ``within``, statistics are those of that column's value, and rows without one take no part.

    Texts are read once, into ``index`` (made by ``term_index`` where not given).  Documents
    are scored in their own partitions (``topk.top_documents``); where the queries are too
    many to go to every task, their terms are joined to postings instead (``bm25_joined``).
    ``statistics`` kept elsewhere (``maintained.TermStatistics``) stand in for those of ``docs``.
    """
    keep = (within,) if within else ()
    index = term_index(docs, id_col, text_col, keep) if index is None else index
    index = index.where(F.col(within).isNotNull()) if within else index
    terms = query_terms(queries)
    found = top_documents(one_field(index, keep), terms, k, {"text": 1.0}, k1, b, within, statistics=statistics)
    if found is None and statistics is not None:
        raise ValueError("too many queries for statistics that are kept elsewhere")
    if found is None:
        return bm25_joined(index, terms, k, k1, b, within)
    return found.select("query", "doc", *keep, "score", "rank")


def one_field(index: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A ``term_index`` as ``topk.top_documents`` reads it: its words are the field ``text``."""
    return index.select("doc", *keep, F.array(F.struct(F.lit("text").alias("field"), F.col("words").alias("words"))).alias("fields"))


def bm25_joined(index: DataFrame, terms: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, within: str | None = None) -> DataFrame:
    """BM25 for any number of query ``terms`` (query, term, qtf), by joins.

    Postings are those of terms that a query has; they are written before document
    frequencies are counted, so the join of a frequent word stands on its own and can be split.
    """
    keep = (within,) if within else ()
    posts = stored(index_postings(index.select("doc", *keep, "len", "words"), terms.select("term").distinct()), "postings")
    stats = index_collection(index, keep)
    full = posts.join(document_frequency(posts, keep), [*keep, "term"])
    full = full.join(F.broadcast(stats), within) if within else full.crossJoin(F.broadcast(stats))
    weight = _bm25(F.col("tf"), F.col("len"), F.col("df"), F.col("n"), F.col("avg_len"), k1, b)
    weighed = full.select("doc", *keep, "term", weight.alias("w"))
    scores = terms.join(weighed, "term").groupBy("query", "doc", *keep).agg(F.round(F.sum(F.col("qtf") * F.col("w")), 6).alias("score"))
    if not within:
        return top(scores, k)
    order = Window.partitionBy("query", within).orderBy(F.desc("score"), "doc")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25f(fields: DataFrame, queries: DataFrame, weights: dict[str, float], k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``query``, ``doc``, ``score``, ``fields``, ``rank`` over ``fields`` (work, field, text).

    Field frequencies are normalised by length, weighted, added and saturated once;
    document frequency counts works; every work counts, even one without a token.  Which
    fields matched is one bit each until the best are known.  A work's fields are brought
    together once; then it is scored where it is (``topk.top_documents``), or by joins where the
    queries are too many to go to every task.  Queries of one text are answered once.
    """
    if k1 <= 0 or not 0 <= b <= 1 or any(w <= 0 for w in weights.values()):
        raise ValueError("k1 and weights must be positive, b between 0 and 1")
    terms = query_terms(queries.select(F.col("text").alias("query"), "text").distinct())
    names = sorted(weights)
    one = F.when(F.col("field").isin(*names), F.struct("field", tokens(F.col("text")).alias("words")))
    index = stored(fields.groupBy(F.col("work").alias("doc")).agg(F.collect_list(one).alias("fields")), "works")
    found = top_documents(index, terms, k, weights, k1, b, empty=True)
    if found is None:
        found = _bm25f_joined(fields, terms, weights, k, k1, b)
    matched = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(1 << i) != 0, F.lit(f)) for i, f in enumerate(names)]))
    answers = found.select(F.col("query").alias("text"), "doc", "score", matched.alias("fields"), "rank")
    return queries.select("query", "text").join(answers, "text").select("query", "doc", "score", "fields", "rank")


def _bm25f_joined(fields: DataFrame, terms: DataFrame, weights: dict[str, float], k: int, k1: float, b: float) -> DataFrame:
    names = sorted(weights)
    table = F.create_map(*[F.lit(x) for f in names for x in (f, F.struct(F.lit(float(weights[f])).alias("w"), F.lit(1 << names.index(f)).alias("bit")))])
    index = stored(fields.select("work", "field", tokens(F.col("text")).alias("words")), "fields")
    words = index.where(F.col("field").isin(*names)).select("work", "field", F.size("words").alias("len"), F.explode("words").alias("term"))
    tf = words.join(terms.select("term").distinct(), "term", "left_semi").groupBy("work", "field", "len", "term").agg(F.count("*").alias("tf"))
    n = index.agg(F.count_distinct("work").alias("n"))
    stats = index.groupBy("field").agg(F.sum(F.size("words")).alias("total")).crossJoin(F.broadcast(n)).select("field", (F.col("total") / F.col("n")).alias("avg_len"), "n")
    norm = F.when(F.col("avg_len") > 0, 1 - b + b * F.col("len") / F.col("avg_len")).otherwise(1.0)
    known = F.element_at(table, F.col("field"))
    part = tf.join(F.broadcast(stats), "field").select("work", "term", "n", known["bit"].alias("bit"), (known["w"] * F.col("tf") / norm).alias("x"))
    per = stored(part.groupBy("work", "term", "n").agg(F.sum("x").alias("x"), F.bit_or("bit").alias("bits")), "weights")
    df = per.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = per.join(df, "term").select("work", "term", "bits", (idf * F.col("x") * (k1 + 1) / (F.col("x") + k1)).alias("w"))
    found = terms.join(weighed, "term").groupBy("query", F.col("work").alias("doc")).agg(F.round(F.sum(F.col("qtf") * F.col("w")), 6).alias("score"), F.bit_or("bits").alias("bits"))
    return top(found, k)


def clean_vectors(vectors: DataFrame, column: str = "vec") -> DataFrame:
    """``vectors`` as arrays of doubles, without those that are null, empty or hold a null or non-finite component."""
    vec = F.col(column).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.withColumn(column, vec).where(F.col(column).isNotNull() & (F.size(column) > 0) & finite)


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int = 10, most: int = cells.CHUNK) -> DataFrame:
    """Exact nearest vectors by cosine: ``query``, ``doc``, ``score``, ``rank`` for (id, vec) against (query, vec), with at most about ``most`` queries a group.

    See ``cells.nearest``.  Vectors that are null, empty or hold null or non-finite components take no part.
    """
    return cells.nearest(cells.cells(vectors), queries, k, chunk=max(most, 1))


def fuse(lanes: DataFrame, top_k: int = 5, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query, lane, id, rank): ``query``, ``id``, ``rrf``, ``lane``, ``rank``.

    ``lane`` is the first that has the row; max(2 x top_k, 10) rows of a query stay.
    """
    got = lanes.groupBy("query", "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("rrf"), F.min("lane").alias("lane"))
    order = Window.partitionBy("query").orderBy(F.desc("rrf"), "lane", "id")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(2 * top_k, 10))


def fuse_works(lanes: DataFrame, constant: int = 60) -> DataFrame:
    """Fusion of works from chunk hits (query, lane, work, chunk, rank): repeated chunks give no extra vote.

    A work's place in a lane is dense over works by their best chunk.  Ties keep first
    appearance, lane 0 first.  ``matches`` counts its chunks, ``best`` is its first.
    """
    best = lanes.groupBy("query", "lane", "work").agg(F.min("rank").alias("first"), F.count("*").alias("m"), F.min_by("chunk", "rank").alias("chunk"))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("query", "lane").orderBy("first", "work")))
    got = placed.groupBy("query", "work").agg(
        F.round(F.sum(1.0 / (constant + F.col("place"))), 9).alias("rrf"), F.sum("m").alias("matches"),
        F.min(F.struct("lane", "place")).alias("seen"), F.min_by("chunk", F.struct("lane", "place")).alias("best"),
    )
    order = Window.partitionBy("query").orderBy(F.desc("rrf"), "seen.lane", "seen.place")
    return got.withColumn("rank", F.row_number().over(order)).select("query", "work", "rrf", "matches", "best", "rank")


def rerank_heuristic(hits: DataFrame, top_k: int = 5, clause: str = "第[一二三四五六七八九十百0-9]+条") -> DataFrame:
    """Hits (query, doc, score, question, content) by score + 0.3 x token overlap + 0.2 where a clause number occurs."""
    bonus = 0.3 * overlap(tokens(F.col("question")), tokens(F.col("content"))) + F.when(F.col("content").rlike(clause), 0.2).otherwise(0.0)
    scored = hits.select("query", "doc", F.round(F.col("score") + bonus, 6).alias("score"))
    return top(scored, top_k)


def rerank_scores(hits: DataFrame, scores: DataFrame, top_k: int = 5) -> DataFrame:
    """Hits (query, doc, rank) by an outside score table (query, doc, score); repeated or non-finite scores are left out.

    Equal scores keep the incoming order.
    """
    good = scores.where(~F.isnan("score") & (F.abs("score") < float("inf"))).groupBy("query", "doc").agg(F.max("score").alias("score"), F.count("*").alias("n")).where("n = 1")
    joined = hits.withColumnRenamed("rank", "was").join(good, ["query", "doc"])
    order = Window.partitionBy("query").orderBy(F.desc("score"), "was", "doc")
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query", "doc", "score", "was", "rank")


def stable_ties(hits: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows with the same ``evidence`` keep the places their group won, its members in incoming order.

    ``hits`` (query, doc, evidence, rank, score), ``incoming`` (query, doc, pos).
    """
    group = ["query", "evidence"]
    slots = hits.select(*group, "rank", "score", F.row_number().over(Window.partitionBy(*group).orderBy("rank")).alias("k"))
    members = hits.join(incoming, ["query", "doc"]).select(*group, "doc", F.row_number().over(Window.partitionBy(*group).orderBy("pos", "doc")).alias("k"))
    spread = hits.groupBy(*group).agg(F.round(F.max("score") - F.min("score"), 6).alias("spread"), F.count("*").alias("members"))
    return slots.join(members, [*group, "k"]).join(spread, group).select("query", "doc", "evidence", "rank", "score", "spread", "members")


def protected_pool(candidates: DataFrame, limit: int = 12) -> DataFrame:
    """Candidates (query, doc, pos, protected): the protected stay, the rest fill up to ``limit`` in order.

    ``kept`` tells which stay, ``overflow`` that the protected alone are too many.
    """
    if limit not in (8, 12, 16, 25):
        raise ValueError("limit must be 8, 12, 16 or 25")
    order = Window.partitionBy("query").orderBy((~F.col("protected")).cast("int"), "pos", "doc")
    placed = candidates.withColumn("place", F.row_number().over(order)).withColumn("n_protected", F.sum(F.col("protected").cast("int")).over(Window.partitionBy("query")))
    kept = F.col("protected") | (F.col("place") <= limit)
    return placed.select("query", "doc", "pos", "protected", kept.alias("kept"), (F.col("n_protected") > limit).alias("overflow"))


def first_works(hits: DataFrame, valid: DataFrame, k: int = 5, selected: DataFrame | None = None) -> DataFrame:
    """The first ``k`` distinct valid works of chunk hits (query, work, pos); a selected one comes first."""
    first = hits.groupBy("query", "work").agg(F.min("pos").alias("pos")).join(valid.select("work").distinct(), "work", "left_semi")
    if selected is not None:
        chosen = selected.select("query", "work").distinct().join(valid.select("work").distinct(), "work", "left_semi").withColumn("front", F.lit(0))
        first = first.join(chosen, ["query", "work"], "full_outer")
    else:
        first = first.withColumn("front", F.lit(None).cast("int"))
    order = Window.partitionBy("query").orderBy(F.coalesce("front", F.lit(1)), F.col("pos").asc_nulls_last(), "work")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "work", "rank")


def exact_lookup(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Queries (query, key) whose whole key is in ``index`` (key, works): ``query``, ``work``; all collisions, no near matches."""
    return queries.join(index, "key").select("query", F.explode("works").alias("work"))


def contains_join(queries: DataFrame, entries: DataFrame, least: int = 1, most: int = 10_000) -> DataFrame:
    """(query, text) joined to the dictionary (entry, phrase) where the text contains the phrase: ``query``, ``entry``, ``phrase``.

    A phrase of three or more words has a word that stands between white space in any text
    that contains it; the longest such word is the join key, so texts and phrases are
    hash-joined.  Shorter phrases have no sure key: they are broadcast, at most ``most`` of
    them.  Phrases shorter than ``least`` characters are left out.
    """
    inner = F.split("phrase", r"\s+")
    inner = F.filter(F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0))), lambda w: F.length(w) > 0)
    key = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w), w.alias("w"))))["w"]
    sized = entries.where(F.length("phrase") >= least).select("entry", "phrase", key.alias("word"))
    if sized.where("word is null").limit(most + 1).count() > most:
        raise ValueError(f"more than {most} phrases of under three words")
    words = queries.select("query", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    # Words meet first; only the texts of those that met are fetched.
    met = words.join(sized.where("word is not null"), "word").select(F.col("query").alias("met"), "entry", "phrase").distinct()
    long_ = met.join(queries.select("query", "text"), F.col("met").eqNullSafe(F.col("query"))).where(F.expr("contains(text, phrase)")).select("query", "entry", "phrase")
    short = queries.join(F.broadcast(sized.where("word is null")), F.expr("contains(text, phrase)")).select("query", "entry", "phrase")
    return long_.unionByName(short).distinct()
