"""Retrieval (Q): benchmark texts are the queries, documents the corpus, sources the departments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import index, relations, topk
from ..operators import retrieve as r
from ..operators.maintained import TermStatistics
from ..session import new_path
from .registry import Tables, query
from .text_plans import FIELDS_SQL, POSTS, part_fields

QUERY_TERMS = "qt AS (SELECT query, term, count(*) AS qtf FROM (SELECT item_id AS query, unnest(regexp_extract_all(lower(text), '[一-鿿]|[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL)"
SCORES = f"""{POSTS}, {QUERY_TERMS},
c AS (SELECT count(*) AS n, avg(len) AS al FROM (SELECT DISTINCT doc, len FROM p)),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query, doc, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))), 6) AS score
  FROM qt JOIN p USING (term) JOIN f USING (term), c GROUP BY query, doc)"""
BM25 = f"WITH {SCORES}, hit AS (SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 10)"
#: A second lane: the share of the query's distinct words that a document has.
LANE2 = f"""{BM25},
qn AS (SELECT query, count(*) AS qn FROM qt GROUP BY query),
s2 AS (SELECT query, doc, round(count(*) / qn, 6) AS score FROM qt JOIN p USING (term) JOIN qn USING (query) GROUP BY query, doc, qn),
hit2 AS (SELECT query, doc, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s2) WHERE rank <= 10),
lanes AS (SELECT query, 0 AS lane, doc, rank FROM hit UNION ALL SELECT query, 1, doc, rank FROM hit2)"""


def asked(t: Tables):
    return t.benchmark.select(F.col("item_id").alias("query"), "text")


def hits(t: Tables, k: int = 10, terms=None):
    return r.bm25(t.documents, asked(t), k, index=terms)


def overlap_hits(t: Tables, terms, k: int = 10):
    q = r.query_terms(asked(t))
    found = topk.top_documents(r.one_field(terms), q, k, {"text": 1.0}, presence=True)
    if found is not None:
        return found
    n = q.groupBy("query").agg(F.count("*").alias("n"))
    posts = index.index_postings(terms, q.select("term").distinct()).select("doc", "term")
    s = q.join(posts, "term").groupBy("query", "doc").agg(F.count("*").alias("m")).join(n, "query")
    return r.top(s.select("query", "doc", F.round(F.col("m") / F.col("n"), 6).alias("score")), k)


def lanes(t: Tables):
    terms = index.term_index(t.documents)
    one = hits(t, terms=terms).select("query", F.lit(0).alias("lane"), "doc", "rank")
    return one.unionByName(overlap_hits(t, terms).select("query", F.lit(1).alias("lane"), "doc", "rank"))


@query("q1_bm25", f"{BM25} SELECT query, doc, score, rank FROM hit")
def _(t: Tables):
    return hits(t)


@query("t3_maintained", f"""WITH d AS (SELECT doc_id AS doc, regexp_extract_all(lower(text), '[一-鿿]|[a-z0-9]+') AS w FROM documents WHERE doc_id % 7 <> 0),
p AS (SELECT doc, len(w) AS len, term, count(*) AS tf FROM (SELECT doc, w, unnest(w) AS term FROM d) GROUP BY ALL), {QUERY_TERMS},
c AS (SELECT count(*) AS n, avg(len) AS al FROM (SELECT DISTINCT doc, len FROM p)), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query, doc, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))), 6) AS score
  FROM qt JOIN p USING (term) JOIN f USING (term), c GROUP BY query, doc)
SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 10""")
def _(t: Tables):
    kept = TermStatistics(t.spark, new_path(t.spark, "t3"))
    third = F.col("doc_id") % 3
    kept.update(added=t.documents.where(third == 0), batch=0)
    kept.update(added=t.documents.where(third == 1), removed=t.documents.where((third == 0) & (F.col("doc_id") % 7 == 0)), batch=1)
    kept.update(added=t.documents.where((third == 2) & (F.col("doc_id") % 7 != 0)), removed=t.documents.where((third == 1) & (F.col("doc_id") % 7 == 0)), batch=2)
    return r.bm25(t.documents.where("doc_id % 7 <> 0"), asked(t), statistics=kept.now())


@query("q2_bm25_within", f"""WITH {POSTS}, {QUERY_TERMS},
c AS (SELECT source, count(*) AS n, avg(len) AS al FROM (SELECT DISTINCT doc, source, len FROM p) GROUP BY source),
f AS (SELECT source, term, count(*) AS df FROM p GROUP BY ALL),
s AS (SELECT query, doc, source, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))), 6) AS score
  FROM qt JOIN p USING (term) JOIN f USING (source, term) JOIN c USING (source) GROUP BY ALL)
SELECT query, doc, source, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 3""")
def _(t: Tables):
    return r.bm25(t.documents, asked(t), 3, within="source")


@query("q3_bm25f", f"""WITH {FIELDS_SQL},
q AS (SELECT p_partkey AS query, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+')) AS term FROM part WHERE p_partkey % 20 = 0),
qt AS (SELECT query, term, count(*) AS qtf FROM q GROUP BY ALL),
st AS (SELECT field, sum(len(w)) / (SELECT count(DISTINCT work) FROM fw) AS al FROM fw GROUP BY field),
tf AS (SELECT work, field, len, term, count(*) AS tf FROM (SELECT work, field, len(w) AS len, unnest(w) AS term FROM fw) GROUP BY ALL),
x AS (SELECT work, term, sum(CASE field WHEN 'name' THEN 5.0 WHEN 'brand' THEN 3.0 ELSE 1.0 END * tf / (0.25 + 0.75 * len / al)) AS x, list(field) AS f FROM tf JOIN st USING (field) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM x GROUP BY term),
s AS (SELECT query, work AS doc, round(sum(qtf * ln(1 + ((SELECT count(DISTINCT work) FROM fw) - df + 0.5) / (df + 0.5)) * x * 2.5 / (x + 1.5)), 6) AS score, list_sort(list_distinct(flatten(list(f)))) AS fields
  FROM qt JOIN x USING (term) JOIN d USING (term) GROUP BY query, work)
SELECT query, doc, score, fields, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 5""")
def _(t: Tables):
    q = t.part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return r.bm25f(part_fields(t), q, {"name": 5.0, "brand": 3.0, "type": 1.0}, 5)


VECTORS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)"


@query("q4_cosine_top", f"""WITH {VECTORS},
s AS (SELECT a.vec_id AS query, b.vec_id AS doc, round(list_dot_product(a.e, b.e) / a.n / b.n, 6) AS score FROM v a, v b WHERE a.vec_id % 20 = 0)
SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 5""")
def _(t: Tables):
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return r.cosine_top(v, v.where("id % 20 = 0").select(F.col("id").alias("query"), "vec"), 5)


@query("q5_vector_delete", "SELECT label, count(*) AS n FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY label")
def _(t: Tables):
    gone = t.labels.where("quality = 0").select(F.col("doc_id").alias("vec_id"))
    return t.embeddings.join(gone, "vec_id", "left_anti").groupBy("label").agg(F.count("*").alias("n"))


@query("q6_fuse", f"""{LANE2}, g AS (SELECT query, doc AS id, round(sum(1.0 / (60 + rank)), 9) AS rrf, min(lane) AS lane FROM lanes GROUP BY query, doc)
SELECT query, id, rrf, lane, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, lane, id) AS rank FROM g) WHERE rank <= 10""")
def _(t: Tables):
    return r.fuse(lanes(t).withColumnRenamed("doc", "id"))


@query("q7_fuse_works", f"""{LANE2},
b AS (SELECT query, lane, source AS work, min(rank) AS first, count(*) AS m, arg_min(l.doc, rank) AS chunk FROM lanes l JOIN (SELECT DISTINCT doc, source FROM d) USING (doc) GROUP BY ALL),
pl AS (SELECT *, row_number() OVER (PARTITION BY query, lane ORDER BY first, work) AS place FROM b),
g AS (SELECT query, work, round(sum(1.0 / (60 + place)), 9) AS rrf, sum(m)::BIGINT AS matches, min((lane, place)) AS seen, arg_min(chunk, (lane, place)) AS best FROM pl GROUP BY query, work)
SELECT query, work, rrf, matches, best, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, seen) AS rank FROM g""")
def _(t: Tables):
    works = t.documents.select(F.col("doc_id").alias("doc"), F.col("source").alias("work"))
    return r.fuse_works(lanes(t).join(works, "doc").withColumnRenamed("doc", "chunk"))


@query("q8_rerank_heuristic", f"""{BM25},
z AS (SELECT h.query, h.doc, h.score, regexp_extract_all(lower(b.text), '[a-z0-9]+') AS qw, regexp_extract_all(lower(x.text), '[a-z0-9]+') AS dw FROM hit h JOIN benchmark b ON b.item_id = h.query JOIN documents x ON x.doc_id = h.doc),
y AS (SELECT query, doc, round(score + 0.3 * len(list_intersect(list_distinct(qw), list_distinct(dw))) / greatest(len(list_distinct(qw)), 1), 6) AS score FROM z)
SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM y) WHERE rank <= 5""")
def _(t: Tables):
    full = hits(t).drop("rank").join(asked(t).withColumnRenamed("text", "question"), "query").join(t.documents.select(F.col("doc_id").alias("doc"), F.col("text").alias("content")), "doc")
    return r.rerank_heuristic(full)


@query("q9_rerank_scores", f"""{BM25}, sc AS (SELECT doc_id AS doc, n_chars % 97 / 8.0 AS score FROM documents WHERE doc_id % 10 <> 3)
SELECT query, doc, score, was, rank FROM (SELECT h.query, h.doc, sc.score, h.rank AS was, row_number() OVER (PARTITION BY h.query ORDER BY sc.score DESC, h.rank, h.doc) AS rank FROM hit h JOIN sc USING (doc)) WHERE rank <= 5""")
def _(t: Tables):
    h = hits(t).select("query", "doc", "rank")
    bad = F.when(F.col("doc_id") % 10 == 3, F.lit(float("nan"))).otherwise(F.col("n_chars") % 97 / 8.0)
    scores = h.select("query", "doc").join(t.documents.select(F.col("doc_id").alias("doc"), bad.alias("score")), "doc")
    return r.rerank_scores(h, scores)


@query("q10_stable_ties", f"""{BM25},
h AS (SELECT query, hit.doc, source AS evidence, rank, score, -hit.doc AS pos FROM hit JOIN (SELECT DISTINCT doc, source FROM d) USING (doc)),
a AS (SELECT query, evidence, rank, score, row_number() OVER (PARTITION BY query, evidence ORDER BY rank) AS k FROM h),
m AS (SELECT query, evidence, doc, row_number() OVER (PARTITION BY query, evidence ORDER BY pos, doc) AS k FROM h),
z AS (SELECT query, evidence, round(max(score) - min(score), 6) AS spread, count(*) AS members FROM h GROUP BY ALL)
SELECT query, doc, evidence, rank, score, spread, members FROM a JOIN m USING (query, evidence, k) JOIN z USING (query, evidence)""")
def _(t: Tables):
    h = hits(t).join(t.documents.select(F.col("doc_id").alias("doc"), F.col("source").alias("evidence")), "doc")
    return r.stable_ties(h, h.select("query", "doc", (-F.col("doc")).alias("pos")))


@query("q11_protected_pool", f"""{BM25},
h AS (SELECT query, doc, rank AS pos, rank <= 2 OR doc % 3 = 0 AS protected FROM hit),
a AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY NOT protected, pos, doc) AS place, sum(protected::INT) OVER (PARTITION BY query) AS np FROM h)
SELECT query, doc, pos, protected, protected OR place <= 8 AS kept, np > 8 AS overflow FROM a""")
def _(t: Tables):
    c = hits(t).select("query", "doc", F.col("rank").alias("pos"), ((F.col("rank") <= 2) | (F.col("doc") % 3 == 0)).alias("protected"))
    return r.protected_pool(c, 8)


@query("q12_first_works", f"""{BM25},
w AS (SELECT query, source AS work, min(rank) AS pos FROM hit JOIN (SELECT DISTINCT doc, source FROM d) USING (doc) WHERE source <> 'src7' GROUP BY ALL),
z AS (SELECT coalesce(w.query, x.query) AS query, coalesce(w.work, x.work) AS work, pos, x.query IS NULL AS rest FROM w FULL JOIN (SELECT item_id AS query, 'src1' AS work FROM benchmark) x USING (query, work))
SELECT query, work, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rest, pos NULLS LAST, work) AS rank FROM z) WHERE rank <= 5""")
def _(t: Tables):
    h = hits(t).join(t.documents.select(F.col("doc_id").alias("doc"), F.col("source").alias("work")), "doc").select("query", "work", F.col("rank").alias("pos"))
    return r.first_works(h, t.documents.where("source <> 'src7'").select(F.col("source").alias("work")), 5, asked(t).select("query", F.lit("src1").alias("work")))


def brands(t: Tables):
    return index.key_index(t.part.withColumnRenamed("p_partkey", "work"), fn.identifier_key(F.concat_ws("-", F.regexp_replace("p_brand", "#", ""), "p_size")))


@query("q13_exact_lookup", "SELECT s.s_suppkey AS query, p.p_partkey AS work FROM supplier s JOIN part p ON replace(p.p_brand, '#', '') || p.p_size = 'Brand' || (s.s_suppkey % 30) || s.s_nationkey")
def _(t: Tables):
    raw = F.concat(F.lit(" brand "), (F.col("s_suppkey") % 30).cast("string"), F.lit("–"), F.col("s_nationkey").cast("string"))
    return r.exact_lookup(t.supplier.select(F.col("s_suppkey").alias("query"), fn.identifier_key(raw).alias("key")), brands(t))


@query("q14_line_lookup", """
WITH l AS (SELECT c_custkey AS query, unnest(['Brand' || (c_nationkey % 25) || '-' || (c_custkey % 50), 'no number']) AS k, unnest([1, 2]) AS line FROM customer)
SELECT l.query, p.p_partkey AS work, 'identifier' AS route, 0 AS lane FROM l JOIN part p ON replace(l.k, '-', '') = replace(p.p_brand, '#', '') || p.p_size
UNION ALL SELECT c_custkey, c_custkey % 7, 'semantic', 1 FROM customer""")
def _(t: Tables):
    text = F.concat(F.lit("Museum number: Brand "), (F.col("c_nationkey") % 25).cast("string"), F.lit("-"), (F.col("c_custkey") % 50).cast("string"), F.lit("\nno number"))
    photos = t.customer.select(F.col("c_custkey").alias("query"), text.alias("text"))
    semantic = t.customer.select(F.col("c_custkey").alias("query"), (F.col("c_custkey") % 7).alias("work"))
    return relations.line_lookup(photos, brands(t), semantic, r"(?i)^\s*museum number\s*:")


@query("q15_named_titles", "SELECT DISTINCT d.doc_id AS query, n.n AS entry FROM documents d JOIN (SELECT DISTINCT substr(text, 1, 30) AS phrase, item_id AS n FROM benchmark) n ON contains(d.text, n.phrase)")
def _(t: Tables):
    titles = t.benchmark.select(F.col("item_id").alias("entry"), F.substring("text", 1, 30).alias("phrase"))
    return r.contains_join(t.documents.select(F.col("doc_id").alias("query"), "text"), titles, 4).select("query", "entry").distinct()


@query("q16_homonym_order", f"""{BM25}, w AS (SELECT item_id AS query, doc_id AS doc FROM benchmark b JOIN documents x ON x.doc_id % 50 = b.item_id % 50)
SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY hit.rank NULLS LAST, doc) AS rank FROM w LEFT JOIN hit USING (query, doc)""")
def _(t: Tables):
    named = asked(t).select("query", (F.col("query") % 50).alias("m")).join(t.documents.select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 50).alias("m")), "m").drop("m")
    return relations.homonym_order(named, hits(t))


@query("q17_metadata_query", """
WITH q AS (SELECT p_partkey AS query, p_size, p_name, p_partkey % 4 AS m FROM part WHERE p_partkey % 20 = 0)
SELECT query, 'date' AS kind, w.p_partkey AS work FROM q JOIN part w ON w.p_size = q.p_size WHERE m = 0
UNION ALL SELECT query, 'author', w.p_partkey FROM q JOIN part w ON list_sort(string_split(w.p_name, ' ')) = list_sort(string_split(q.p_name, ' ')) WHERE m = 1""")
def _(t: Tables):
    content = F.concat(F.lit("Maker: "), "p_name", F.lit("\nDate: "), (F.col("p_size") + 1800).cast("string"))
    works = index.label_index(t.part.select(F.col("p_partkey").alias("work"), content.alias("content")), {"author": ("Maker",), "date": ("Date",)}, "unknown")
    m = F.col("p_partkey") % 4
    text = F.when(m == 0, F.concat(F.lit("Find works dated "), F.col("p_size") + 1800)).when(m == 1, F.concat(F.lit("find works by "), "p_name", F.lit("."))).when(m == 2, F.concat(F.lit("not by "), "p_name")).otherwise(F.col("p_name"))
    return relations.metadata_lookup(t.part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query"), text.alias("text")), works, "unknown").select("query", "kind", "work")


@query("q18_material_preference", f"""{BM25}, h AS (SELECT query, doc, rank AS pos, doc % 4 = 0 AS m FROM hit)
SELECT query, doc, m AS promoted, row_number() OVER (PARTITION BY query ORDER BY NOT m, pos) AS rank FROM h""")
def _(t: Tables):
    content = F.when(F.col("doc") % 4 == 0, "Materials: Bronze\nMaterials: bronze").when(F.col("doc") % 4 == 1, "Materials: bronze\nMaterials: wood").when(F.col("doc") % 4 == 2, "Materials: possibly bronze").otherwise("Title: bronze")
    h = hits(t).select("query", "doc", F.col("rank").alias("pos"), content.alias("content"), F.lit("bronze").alias("material"))
    return relations.prefer_material(h, "Materials", "possibly|probably")


WORDS_SQL = "(VALUES ('the', 'der die', 1), ('and', 'und', 2), ('erth', 'erde', 3)) AS g(phrase, translation, place)"


def dictionary(t: Tables):
    return t.spark.createDataFrame([("the", "der die", 1), ("and", "und", 2), ("erth", "erde", 3)], "phrase string, translation string, place int")


@query("q19_glossary", rf"""
WITH m AS (SELECT item_id, list(translation ORDER BY place) AS t, count(DISTINCT translation) AS n FROM benchmark JOIN {WORDS_SQL} ON contains(lower(text), phrase) WHERE NOT regexp_matches(text, '(?i)\b(not|without)\b') GROUP BY item_id)
SELECT b.item_id AS query, coalesce(n, 0)::INT AS concepts, coalesce(n, 0) >= 2 AS applied, md5(CASE WHEN n >= 2 THEN text || ' ' || array_to_string(t, ' ') ELSE text END) AS digest FROM benchmark b LEFT JOIN m USING (item_id)""")
def _(t: Tables):
    found = relations.expand_glossary(asked(t), dictionary(t), fn.any_word("not|without"))
    return found.select("query", "concepts", "applied", F.md5("expanded").alias("digest"))


@query("q20_synonyms", f"""
WITH m AS (SELECT item_id, list(translation ORDER BY place) AS t FROM benchmark JOIN {WORDS_SQL} ON contains(text, phrase) AND NOT contains(text, translation) GROUP BY item_id)
SELECT item_id AS query, md5(text) AS digest, 0 AS variant FROM benchmark UNION ALL SELECT item_id, md5(text || ' ' || array_to_string(t, ' ')), 1 FROM benchmark JOIN m USING (item_id)""")
def _(t: Tables):
    return relations.expand_synonyms(asked(t), dictionary(t)).select("query", F.md5("text").alias("digest"), "variant")


@query("q21_coverage_gate", f"""{BM25},
qd AS (SELECT DISTINCT query, term FROM qt WHERE length(term) >= 2 AND term NOT IN ('the', 'of')), n AS (SELECT query, count(*) AS n FROM qd GROUP BY query),
cv AS (SELECT h.query, h.doc, round(count(p.term) / n, 6) AS coverage FROM hit h JOIN n USING (query) JOIN qd USING (query) LEFT JOIN p ON p.doc = h.doc AND p.term = qd.term WHERE h.rank <= 5 GROUP BY h.query, h.doc, n)
SELECT query, max(coverage) AS coverage, max(coverage) >= 0.5 AS field_lane FROM cv GROUP BY query""")
def _(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias("doc"), F.col("text").alias("content"))
    top5 = hits(t, 5).join(asked(t), "query").join(docs, "doc")
    return relations.coverage_gate(top5, ("the", "of")).select("query", "coverage", "field_lane")


@query("q22_evidence_bridge", """
WITH l AS (SELECT doc_id AS work, string_split(coalesce(text, ''), chr(10)) AS x, length(coalesce(text, '')) AS n FROM documents),
p AS (SELECT work, n, i - 1 AS chunk, coalesce(list_sum(list_transform(x[1:i - 1], lambda y: length(y) + 1)), 0) AS start, coalesce(list_sum(list_transform(x[1:i - 1], lambda y: length(y) + 1)), 0) + length(x[i]) AS stop FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM l)),
c AS (SELECT work, chunk, greatest(0, least(stop, 3 * n // 4) - greatest(start, n // 4)) AS shared FROM p)
SELECT work, arg_max(chunk, (shared, -chunk))::BIGINT AS chunk, max(shared)::BIGINT AS shared FROM c WHERE shared > 0 GROUP BY work""")
def _(t: Tables):
    d = t.documents.select(F.col("doc_id").alias("work"), F.coalesce("text", F.lit("")).alias("text"))
    # A line is a chunk; the quote is the middle half of the text.
    lines = d.select("work", F.posexplode(F.split("text", "\n")).alias("chunk", "x"))
    stop = F.sum(F.length("x") + 1).over(Window.partitionBy("work").orderBy("chunk")) - 1
    spans = lines.select("work", "chunk", (stop - F.length("x")).alias("start"), stop.alias("stop"))
    n = F.length("text")
    quotes = d.select("work", F.floor(n / 4).alias("start"), F.floor(3 * n / 4).alias("stop"), F.lit(1.0).alias("weight"))
    return relations.bridge(quotes, spans).select("work", F.col("chunk").cast("long").alias("chunk"), F.col("shared").cast("long").alias("shared"))


@query("q23_multi_query", f"""{BM25},
x AS (SELECT h.query, h.doc, h.score, 0 AS v, h.rank AS pos FROM hit h UNION ALL SELECT query, doc, score, 1, rank FROM hit WHERE rank <= 3),
y AS (SELECT query, doc, arg_min(score, (v, pos)) AS score FROM x JOIN (SELECT DISTINCT doc, source FROM d WHERE source <> 'src4') USING (doc) GROUP BY query, doc)
SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM y) WHERE rank <= 5""")
def _(t: Tables):
    h = hits(t)
    every = h.select("query", "doc", "score", F.lit(0).alias("variant"), F.col("rank").alias("pos")).unionByName(h.where("rank <= 3").select("query", "doc", "score", F.lit(1).alias("variant"), F.col("rank").alias("pos")))
    active = t.documents.where("source <> 'src4'").select(F.col("doc_id").alias("doc"))
    return relations.first_hits(every, active, 5)


ROUTES_SQL = "(VALUES ('a', 'the ', 1), ('a', 'and', 2), ('b', 'ciónes', 1), ('c', 'heit', 1), ('c', 'keit', 2)) AS k(dept, phrase, place)"


def route_words(t: Tables):
    return t.spark.createDataFrame([("a", "the ", 1), ("a", "and", 2), ("b", "ciónes", 1), ("c", "heit", 1), ("c", "keit", 2)], "dept string, phrase string, place int")


@query("q24_department_routing", f"""
WITH m AS (SELECT item_id, dept, arg_min(phrase, place) AS reason FROM benchmark JOIN {ROUTES_SQL} ON contains(text, phrase) GROUP BY ALL),
g AS (SELECT item_id, list(dept ORDER BY dept) AS depts, list(reason ORDER BY dept) AS reasons FROM m GROUP BY item_id)
SELECT item_id AS query, coalesce(depts, ['a', 'b', 'c']) AS depts, coalesce(reasons, []) AS reasons, CASE WHEN depts IS NULL THEN 0.3 ELSE round(least(0.95, 0.6 + 0.1 * len(depts)), 2) END AS confidence
FROM benchmark LEFT JOIN g USING (item_id)""")
def _(t: Tables):
    return relations.route_departments(asked(t), route_words(t))


@query("q25_intent", """
SELECT item_id AS query, CASE WHEN contains(text, 'cion') OR contains(text, 'ción') THEN 'deadline' WHEN contains(text, 'keit') THEN 'guide' WHEN contains(text, 'the') THEN 'consult' ELSE 'other' END AS intent FROM benchmark""")
def _(t: Tables):
    rules = (("deadline", ("cion", "ción")), ("guide", ("keit",)), ("consult", ("the",)))
    return asked(t).select("query", relations.first_rule(F.col("text"), rules, "other").alias("intent"))


@query("q26_conversation_routing", r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\b(versus|threnst|than)\b') THEN 'comparison' WHEN regexp_matches(text, '(?i)\b(not|nicht)\b') THEN 'negation'
  WHEN regexp_matches(text, '[A-Z]{1,4}-[0-9]+') THEN 'identifier' WHEN contains(text, 'This') THEN 'title' WHEN regexp_matches(text, '(?i)\b(find|de)\b') THEN 'find' WHEN turn > 0 THEN 'followup' ELSE 'question' END AS route
FROM conversations WHERE role = 'user'""")
def _(t: Tables):
    x = F.col("text")
    rules = (
        ("comparison", x.rlike(fn.any_word("versus|threnst|than"))), ("negation", x.rlike(fn.any_word("not|nicht"))), ("identifier", x.rlike("[A-Z]{1,4}-[0-9]+")),
        ("title", x.contains("This")), ("find", x.rlike(fn.any_word("find|de"))), ("followup", F.col("turn") > 0),
    )
    return t.conversations.where("role = 'user'").select("conv_id", "turn", relations.first_test(rules, "question").alias("route"))


@query("q26_longest_title", """
WITH m AS (SELECT doc_id, item_id, substr(text_, 1, 20 + item_id % 5) AS name FROM (SELECT d.doc_id, b.item_id, b.text AS text_, d.text AS body FROM documents d, benchmark b) WHERE contains(body, substr(text_, 1, 20 + item_id % 5)))
SELECT doc_id AS query, arg_max(item_id, (length(name), -item_id)) AS entry FROM m GROUP BY doc_id""")
def _(t: Tables):
    names = t.benchmark.select(F.col("item_id").alias("entry"), F.expr("substring(text, 1, int(20 + item_id % 5))").alias("phrase"))
    found = r.contains_join(t.documents.select(F.col("doc_id").alias("query"), "text"), names)
    return relations.longest(found).select("query", "entry")


@query("q27_triggers", f"""
WITH m AS (SELECT DISTINCT b.item_id, dept FROM benchmark b JOIN {ROUTES_SQL} ON contains(text, phrase) WHERE dept <> 'c'),
g AS (SELECT dept, max(place) AS priority FROM {ROUTES_SQL} GROUP BY dept)
SELECT item_id AS query, dept AS rule, priority, row_number() OVER (PARTITION BY item_id ORDER BY priority DESC, dept) AS rank FROM m JOIN g USING (dept)""")
def _(t: Tables):
    rules = route_words(t).groupBy(F.col("dept").alias("rule")).agg(F.collect_set("phrase").alias("patterns"), F.max("place").alias("priority"))
    return relations.triggered(asked(t), rules.where("rule <> 'c'"))


@query("q28_cascade", f"""{BM25},
x AS (SELECT query, doc, 2 AS lane, rank AS pos FROM hit UNION ALL SELECT item_id, item_id, 0, 1 FROM benchmark WHERE item_id % 5 = 0 UNION ALL SELECT item_id, item_id + 1, 1, 1 FROM benchmark WHERE item_id % 3 = 0),
y AS (SELECT *, min(lane) OVER (PARTITION BY query) AS first FROM x)
SELECT query, doc, lane, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos, doc) AS rank FROM y WHERE lane = first) WHERE rank <= 5""")
def _(t: Tables):
    q = asked(t)
    exact = q.where("query % 5 = 0").select("query", F.col("query").alias("doc"), F.lit(1).alias("pos"))
    titled = q.where("query % 3 = 0").select("query", (F.col("query") + 1).alias("doc"), F.lit(1).alias("pos"))
    return relations.cascade([exact, titled, hits(t).select("query", "doc", F.col("rank").alias("pos"))], 5)
