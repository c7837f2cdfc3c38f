"""Relations (L), evidence (E) and visual vectors (V)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import identifier_key
from ..operators import documents as d
from ..operators import evidence as e
from ..operators import index
from ..operators import visual as v
from ..operators.expand import tasks_for
from ..operators.retrieve import cosine_top
from .registry import Tables, query


@query("l1_references", """
WITH n AS (SELECT s_suppkey AS src, p_name AS name FROM supplier JOIN part ON p_partkey = s_suppkey),
t AS (SELECT p_partkey AS dst, CASE WHEN p_partkey % 50 = 0 THEN '' ELSE p_name || ' ' || p_brand END AS title FROM part)
SELECT src, dst, 2::BIGINT AS n_matches, 0.95::DOUBLE AS confidence FROM n JOIN t ON src <> dst AND title <> '' AND (contains(title, name) OR contains(name, title))""")
def _(t: Tables):
    named = t.supplier.join(t.part, F.col("p_partkey") == F.col("s_suppkey"))
    c = named.select(F.col("s_suppkey").alias("doc"), F.concat(F.lit("see <"), "p_name", F.lit("> and see <"), "p_name", F.lit(">")).alias("text"))
    titles = t.part.select(F.col("p_partkey").alias("doc"), F.when(F.col("p_partkey") % 50 == 0, "").otherwise(F.concat_ws(" ", "p_name", "p_brand")).alias("title"))
    return d.references(c, titles, ("see <([^>]{2,40})>",))


PAIR = """n AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM n)"""


def near(t: Tables, k: int = 8):
    vec = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    # One more than asked for: the nearest vector of each is itself, or as near.
    found = cosine_top(vec, vec.where("id % 20 = 0").select(F.col("id").alias("query"), "vec"), k + 1)
    s = found.where("query <> doc").select(F.col("query").alias("a"), F.col("doc").alias("b"), "score")
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@query("l2_conflicts", f"""WITH {PAIR}, c AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
j AS (SELECT k.a, k.b, score, x.source AS sa, y.source AS sb, x.w AS wa, y.w AS wb, row_number() OVER (PARTITION BY k.a ORDER BY score DESC, k.b) AS r FROM k JOIN c x ON x.doc_id = k.a JOIN c y ON y.doc_id = k.b WHERE rank <= 8 AND k.b % 5 > 0),
o AS (SELECT a, b, score, round(len(list_intersect(wa, wb)) / greatest(least(len(wa), len(wb)), 1), 6) AS overlap FROM j WHERE r <= 3 AND sa <> sb) SELECT * FROM o WHERE score >= 0.3 AND overlap >= 0.15""")
def _(t: Tables):
    chunks = t.documents.select(F.col("doc_id").alias("chunk"), F.col("doc_id").alias("doc"), F.col("source").alias("dept"), (F.col("doc_id") % 5 > 0).alias("active"), "text")
    return d.conflict_candidates(near(t), chunks, 3, 0.3, 0.15)


@query("l3_conflict_edges", "SELECT o_orderkey AS a, o_custkey AS b, round((o_orderkey % 10) / 10, 3) AS confidence FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 10 >= 6")
def _(t: Tables):
    c = t.orders.select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))
    verdicts = t.orders.select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"), (F.col("o_orderstatus") == "F").alias("is_conflict"), (F.col("o_orderkey") % 10 / 10).alias("confidence"))
    return d.conflict_edges(c, verdicts)


@query("l4_relations", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'R' OR l_linestatus = 'R') AND l_quantity > 40")
def _(t: Tables):
    edges = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("src"), F.col("l_linestatus").alias("dst"), F.when(F.col("l_quantity") > 40, "big").otherwise("small").alias("kind"))
    return d.relations_of(edges, "R", "big").select("l_orderkey", "l_linenumber")


#: Vectors of the users' turns: the hash embedding of their texts, equal texts once.
def asked_vectors(t: Tables):
    turns = t.conversations.where("role = 'user'").groupBy("text").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    rows = turns.select((F.col("first.conv_id") * 1000 + F.col("first.turn")).alias("doc_id"), "text")
    return index.hash_vectors(rows).withColumnRenamed("doc", "id")


TURNS = r"""
u AS (SELECT conv_id * 1000 + turn AS id, regexp_replace(lower(text), '\s+', '', 'g') AS x FROM (SELECT text, min((conv_id, turn)) AS f, f[1] AS conv_id, f[2] AS turn FROM conversations WHERE role = 'user' GROUP BY text)),
g AS (SELECT id, unnest(CASE WHEN length(x) > 2 THEN list_prepend(x, list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) ELSE [x] END) AS g FROM u WHERE x <> ''),
h AS (SELECT id, n, unnest([md5(g), md5(g || ' ')]) AS h FROM (SELECT id, g, count(*) AS n FROM g GROUP BY ALL)),
c AS (SELECT id, ('0x' || substr(h, 1, 8))::BIGINT % 128 AS i, sum(n * CASE WHEN ('0x' || substr(h, 9, 2))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END) AS s FROM h GROUP BY ALL),
e AS (SELECT id, list_transform(range(0, 128), lambda k: coalesce(map_from_entries(list((i, s)))[k], 0.0)::DOUBLE) AS v FROM c WHERE s <> 0 GROUP BY id),
pair AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 1 - {eps})"""


@query("l5_near_pairs", f"WITH {TURNS.format(eps=0.2)} SELECT a, b FROM pair")
def _(t: Tables):
    return d.near_exact(asked_vectors(t), 0.2)


@query("l5_clusters", f"""WITH RECURSIVE {TURNS.format(eps=0.35)},
both_ AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
walk(a, b) AS (SELECT a, a FROM both_ UNION SELECT walk.a, both_.b FROM walk JOIN both_ ON both_.a = walk.b)
SELECT a AS node, min(b) AS cluster FROM walk GROUP BY a""")
def _(t: Tables):
    return d.clusters(d.near_exact(asked_vectors(t), 0.35, forest=True))


@query("l6_first_token", "SELECT w[1] AS token, count(*) AS n FROM (SELECT regexp_extract_all(lower(text), '[一-鿿]|[a-z0-9]+') AS w FROM conversations WHERE role = 'user') WHERE len(w) > 0 GROUP BY 1 HAVING count(*) >= 2")
def _(t: Tables):
    return d.by_first_token(t.conversations.where("role = 'user'").select(F.col("conv_id").alias("query"), "text"))


@query("l7_skill_drafts", """
WITH m AS (SELECT source, regexp_extract_all(lower(text), '[一-鿿]|[a-z0-9]+') AS w FROM documents), n AS (SELECT source, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 20),
c AS (SELECT source, w, count(*) AS c FROM (SELECT source, unnest(w) AS w FROM m JOIN n USING (source)) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, w) AS k FROM c)
SELECT source AS cluster, list(w ORDER BY k) AS patterns, 'skill_' || arg_min(w, k) AS name, round(least(0.95, 0.5 + 0.02 * any_value(n)), 6) AS confidence FROM k JOIN n USING (source) WHERE k <= 6 GROUP BY source""")
def _(t: Tables):
    return d.skill_drafts(t.documents.select(F.col("source").alias("cluster"), "text"))


@query("l8_backtest", """
WITH s AS (SELECT p_type AS skill, list(DISTINCT split_part(p_name, ' ', 1)) AS p FROM part GROUP BY 1 UNION ALL SELECT 'NONE', ['zzz']),
h AS (SELECT skill, p_partkey, p_size > 25 AS ok FROM part JOIN s ON len(list_filter(p, lambda x: contains(part.p_name, x))) > 0)
SELECT s.skill, count(h.ok) AS n, coalesce(round(avg(ok::INT), 6), 0) AS success FROM s LEFT JOIN h USING (skill) GROUP BY 1""")
def _(t: Tables):
    s = t.part.groupBy(F.col("p_type").alias("skill")).agg(F.collect_set(F.split("p_name", " ")[0]).alias("patterns"))
    none = t.part.select(F.lit("NONE").alias("skill"), F.array(F.lit("zzz")).alias("patterns")).distinct()
    return d.backtest(s.unionByName(none), t.part.select(F.col("p_partkey").alias("trace"), F.col("p_name").alias("text"), (F.col("p_size") > 25).alias("ok")))


@query("l9_merge_proposals", """
WITH s AS (SELECT s_suppkey AS skill, s_nationkey % 3 AS action, ['p' || (s_nationkey % 4), 'q', 'r' || (s_suppkey % 2)] AS p FROM supplier),
j AS (SELECT a.skill AS a, b.skill AS b, round(len(list_intersect(a.p, b.p)) / (6 - len(list_intersect(a.p, b.p))), 6) AS jaccard FROM s a JOIN s b ON a.skill < b.skill AND a.action = b.action) SELECT a, b, jaccard FROM j WHERE jaccard > 0.8 AND b <> a + 12""")
def _(t: Tables):
    n = F.col("s_nationkey")
    pats = F.array(F.concat(F.lit("p"), (n % 4).cast("string")), F.lit("q"), F.concat(F.lit("r"), (F.col("s_suppkey") % 2).cast("string")))
    s = t.supplier.select(F.col("s_suppkey").alias("skill"), (n % 3).alias("action"), pats.alias("patterns"))
    return d.merge_proposals(s, t.supplier.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 12).alias("b")))


#: Every document claims something: of itself, of the next one, or of one that nobody knows.
CLAIMS = """
t AS (SELECT doc_id, lang, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
c AS (SELECT doc_id AS claim, CASE lang WHEN 'fr' THEN doc_id + 1 WHEN 'de' THEN -1 - doc_id ELSE doc_id END AS source, substr(text, 1, n // 2) AS quote, substr(text, 3 * n // 4, 4) AS value FROM t),
j AS (SELECT c.*, t.text AS content FROM c LEFT JOIN t ON t.doc_id = c.source)"""


def _claims(t: Tables):
    text, lang = F.coalesce("text", F.lit("")), F.col("lang")
    n = F.length("text")
    rows = t.documents.select("doc_id", "lang", text.alias("text"))
    return rows.select(
        F.col("doc_id").alias("claim"), F.when(lang == "fr", F.col("doc_id") + 1).when(lang == "de", -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("source"),
        F.substring("text", F.lit(1), F.floor(n / 2).cast("int")).alias("quote"), F.substring("text", F.floor(3 * n / 4).cast("int"), F.lit(4)).alias("value"),
    )


def _sources(t: Tables):
    return t.documents.select(F.col("doc_id").alias("source"), F.coalesce("text", F.lit("")).alias("content"))


@query("e1_claims", f"WITH {CLAIMS} SELECT claim, issue FROM (SELECT claim, CASE WHEN content IS NULL THEN 'unknown_source' WHEN NOT contains(content, quote) THEN 'quote_not_in_source' END AS issue FROM j) WHERE issue IS NOT NULL")
def _(t: Tables):
    return e.claim_issues(_claims(t), _sources(t))


@query("e2_facts", f"""WITH {CLAIMS} SELECT fact, issue FROM (SELECT claim AS fact, CASE WHEN content IS NULL THEN 'unknown_source' WHEN NOT contains(content, quote) THEN 'quote_not_in_source' WHEN NOT contains(quote, value) THEN 'value_not_in_quote' END AS issue FROM j)
WHERE issue IS NOT NULL""")
def _(t: Tables):
    return e.fact_issues(_claims(t).withColumnRenamed("claim", "fact"), _sources(t))


@query("e3_bare_place", "SELECT p_partkey AS fact, p_partkey % 3 = 0 AS bare FROM part")
def _(t: Tables):
    q = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("\n Place: "), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Place: "), "p_name", F.lit("\nmade there"))).otherwise(F.col("p_name"))
    return t.part.select(F.col("p_partkey").alias("fact"), e.is_bare_place(q).alias("bare"))


def _spans(t: Tables):
    """Quotes of every text, by shares of its length: neighbours, overlaps, one apart and one said twice."""
    n = F.length("text")
    part = lambda a, z: F.substring("text", F.floor(n * a / 20).cast("int") + 1, F.floor(n * z / 20).cast("int") - F.floor(n * a / 20).cast("int"))
    cut = F.explode(F.array(*[part(a, z) for a, z in ((0, 4), (3, 6), (9, 11), (14, 15), (14, 15))]))
    return t.documents.select(F.col("doc_id").alias("source"), cut.alias("quote")).where("quote <> ''")


@query("e4_spans", r"""
WITH n AS (SELECT doc_id AS source, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
q AS (SELECT DISTINCT source, text, unnest([substr(text, 1, n * 4 // 20), substr(text, n * 3 // 20 + 1, n * 6 // 20 - n * 3 // 20), substr(text, n * 9 // 20 + 1, n * 11 // 20 - n * 9 // 20), substr(text, n * 14 // 20 + 1, n * 15 // 20 - n * 14 // 20)]) AS q FROM n),
a AS (SELECT source, text, instr(text, q) - 1 AS s, instr(text, q) - 1 + length(q) AS e FROM q WHERE q <> ''),
w AS (SELECT *, max(e) OVER (PARTITION BY source ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a),
m AS (SELECT *, CASE WHEN seen IS NULL OR s > seen AND regexp_replace(substr(text, seen + 1, s - seen), '\s', '', 'g') <> '' THEN 1 ELSE 0 END AS new FROM w),
i AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT source, min(s) AS start, max(e) AS stop FROM i GROUP BY source, island""")
def _(t: Tables):
    return e.merged_spans(_spans(t), _sources(t))


@query("e5_covered", r"""
WITH RECURSIVE q AS (SELECT doc_id AS id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, coalesce(text, '') || CASE WHEN doc_id % 2 = 1 THEN chr(1) ELSE '' END AS quote FROM documents),
s AS (SELECT DISTINCT id, quote, unnest(CASE id % 3 WHEN 0 THEN [substr(t, 1, n * 11 // 20), substr(t, n * 9 // 20 + 1)] WHEN 1 THEN [substr(t, 1, n * 8 // 20), substr(t, n * 12 // 20 + 1)] ELSE [t] END) AS span FROM q),
o(id, quote, span, pos) AS (SELECT id, quote, span, instr(quote, span) FROM s WHERE span <> '' AND contains(quote, span)
  UNION ALL SELECT id, quote, span, pos + instr(substr(quote, pos + 1), span) FROM o WHERE contains(substr(quote, pos + 1), span)),
w AS (SELECT id, quote, pos - 1 AS a, pos - 1 + length(span) AS b FROM o),
g AS (SELECT id, quote, coalesce(max(b) OVER (PARTITION BY id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f, a AS e FROM w
  UNION ALL SELECT id, quote, coalesce((SELECT max(b) FROM w WHERE w.id = q.id), 0), length(quote) FROM q),
u AS (SELECT DISTINCT id FROM g WHERE e > f AND regexp_matches(substr(quote, f + 1, e - f), '\S'))
SELECT id, trim(quote) <> '' AND (coalesce((SELECT bool_or(contains(span, s.quote)) FROM s WHERE s.id = q.id), false) OR id NOT IN (SELECT id FROM u)) AS covered FROM q""")
def _(t: Tables):
    # Quotes are whole texts; every second one ends with a character of no text.  Spans overlap, leave a fifth out, or are the text.
    text, n, k = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit(""))), F.col("doc_id") % 3
    to = lambda share: F.floor(n * share / 20).cast("int")
    quotes = t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("source"), F.concat(text, F.when(F.col("doc_id") % 2 == 1, "\x01").otherwise("")).alias("quote"))
    two = lambda a, b: F.array(F.substring(text, F.lit(1), to(a)), F.substring(text, to(b) + 1, n))
    cut = F.when(k == 0, two(11, 9)).when(k == 1, two(8, 12)).otherwise(F.array(text))
    return e.covered_quotes(quotes, t.documents.select(F.col("doc_id").alias("source"), F.explode(cut).alias("span")))


@query("e6_uncited", "SELECT p_partkey AS id, list_filter([p_size, 99], lambda x: x <> p_size OR p_partkey % 2 = 0) AS missing FROM part")
def _(t: Tables):
    return t.part.select(F.col("p_partkey").alias("id"), e.uncited(F.array("p_size", F.lit(99)), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit(-1))).otherwise(F.array("p_size"))).alias("missing"))


@query("e7_review_passes", """
WITH l AS (SELECT l_orderkey AS draft, l_linenumber - 1 AS i, l_returnflag <> 'A' AS ok FROM lineitem), g AS (SELECT draft, list_sort(list(i)) AS seen, bool_and(ok) AS good, count(*) AS c FROM l GROUP BY 1)
SELECT draft, good AND seen = range(0, 3) AS passed FROM g""")
def _(t: Tables):
    yes = F.lit(True)
    return e.review_passes(t.lineitem.select(F.col("l_orderkey").alias("draft"), F.lit(3).alias("n"), (F.col("l_linenumber") - 1).alias("index"), (F.col("l_returnflag") != "A").alias("supported"), yes.alias("answered"), yes.alias("identity")))


def _labelled_works(t: Tables):
    p = F.col("p_partkey")
    content = F.concat(F.lit("Maker: "), "p_brand", F.lit("\nMaterial: "), "p_type", F.when(p % 5 == 0, "\nMaterial: other").otherwise(""))
    return t.part.select(p.alias("work"), F.when(p % 7 == 0, "archived").otherwise("active").alias("status"), F.lit("h").alias("hash"), content.alias("content"))


ASK = {"maker": r"who made (?:it|this)", "material": "what is it made of"}
LABELS = {"maker": "Maker", "material": "Material"}


@query("e8_field_answers", "SELECT p_partkey AS question, CASE p_partkey % 3 WHEN 0 THEN 'maker' ELSE 'material' END AS field, CASE p_partkey % 3 WHEN 0 THEN p_brand ELSE p_type END AS value FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 7 > 0 AND (p_partkey % 3 = 0 OR p_partkey % 5 > 0)")
def _(t: Tables):
    m = F.col("p_partkey") % 3
    text = F.when(m == 0, "Who made it?").when(m == 1, "what is it made of").otherwise("who made it and why?")
    return e.field_answers(t.part.select(F.col("p_partkey").alias("question"), text.alias("text"), F.col("p_partkey").alias("work"), F.lit("h").alias("hash")), _labelled_works(t), ASK, LABELS)


@query("e9_field_audit", "SELECT 'maker' AS field, count(*) AS answerable FROM part UNION ALL SELECT 'material', count(*) FILTER (p_partkey % 5 > 0) FROM part")
def _(t: Tables):
    return e.field_audit(_labelled_works(t), LABELS)


@query("e10_citations", "SELECT l_orderkey AS answer, p_partkey AS chunk, p_partkey AS doc, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS title, substr(p_name, 1, 6) AS snippet FROM lineitem JOIN part ON p_partkey = l_partkey")
def _(t: Tables):
    p = F.col("p_partkey")
    chunks = t.part.select(p.alias("chunk"), p.alias("doc"), F.when(p % 2 == 0, F.col("p_brand")).alias("title"), F.col("p_name").alias("text"))
    return e.citations(t.lineitem.select(F.col("l_orderkey").alias("answer"), F.col("l_partkey").alias("chunk")), chunks, t.part.select(p.alias("doc"), F.col("p_type").alias("title")), 6)


@query("e11_extractive", "SELECT conv_id AS answer, md5(string_agg(substr(text, 1, 300), chr(10) ORDER BY turn) FILTER (turn < 3)) AS digest FROM conversations GROUP BY 1")
def _(t: Tables):
    return e.extractive(t.conversations.select(F.col("conv_id").alias("answer"), F.col("turn").alias("rank"), F.col("turn").alias("chunk"), "text")).select("answer", F.md5("text").alias("digest"))


@query("e12_merged_answers", """
WITH p AS (SELECT o_custkey AS request, o_orderstatus AS dept, CASE WHEN count(*) % 3 > 0 THEN 'n' || count(*) END AS text, max(o_orderkey) AS cite, count(*) / 10 AS confidence FROM orders GROUP BY 1, 2)
SELECT request, coalesce(string_agg('[' || dept || '] ' || text, chr(10) || chr(10) ORDER BY dept) FILTER (text IS NOT NULL), '') AS text, coalesce(list(cite ORDER BY cite) FILTER (text IS NOT NULL), []) AS cites,
 coalesce(list(dept ORDER BY dept) FILTER (text IS NOT NULL), []) AS depts, round(avg(confidence) FILTER (text IS NOT NULL), 6) AS confidence, bool_or(text IS NULL) AS partial FROM p GROUP BY request""")
def _(t: Tables):
    n = F.count("*")
    p = t.orders.groupBy(F.col("o_custkey").alias("request"), F.col("o_orderstatus").alias("dept")).agg(F.when(n % 3 > 0, F.concat(F.lit("n"), n.cast("string"))).alias("text"), F.array(F.max("o_orderkey")).alias("cites"), (n / 10).alias("confidence"))
    return e.merged_answers(p)


@query("e13_heuristic_score", "SELECT event_id AS id, round(1.0 - CASE WHEN user_id % 3 = 0 THEN 0.3 ELSE 0 END - CASE WHEN event_type = 'error' THEN 0.3 ELSE 0 END, 6) AS score FROM events")
def _(t: Tables):
    return t.events.select(F.col("event_id").alias("id"), e.heuristic_score(F.when(F.col("event_type") != "error", F.col("event_type")), F.col("user_id") % 3).alias("score"))


@query("e14_scripts", "SELECT p_partkey AS script, p_partkey % 2 = 0 AND p_partkey % 3 > 0 AND p_partkey % 5 > 0 AND p_size > 5 AS valid FROM part")
def _(t: Tables):
    p = F.col("p_partkey")
    s = t.part.select(p.alias("script"), p.alias("work"), F.when(p % 2 == 0, "ready").otherwise("draft").alias("status"), F.when(p % 3 > 0, "h").otherwise("old").alias("source_hash"), F.lit("c").alias("content_hash"), F.lit("c").alias("draft_hash"), F.array(F.when(p % 5 > 0, F.col("p_name")).otherwise("zzz")).alias("quotes"), (F.col("p_size") > 5).alias("passed"))
    return e.valid_scripts(s, t.part.select(p.alias("work"), F.lit("h").alias("hash"), F.col("p_name").alias("content")))


VIEWS = "s AS (SELECT q.vec_id // 100 AS query, q.vec_id AS qview, b.vec_id AS view, b.label AS work, list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0)"


def _views(t: Tables):
    unit = F.col("embedding")
    views = t.embeddings.select(F.col("vec_id").alias("view"), F.col("label").alias("work"), unit.alias("vec"))
    q = t.embeddings.where("vec_id % 20 = 0").select(F.floor(F.col("vec_id") / 100).alias("query"), F.col("vec_id").alias("qview"), unit.alias("qvec"))
    return q, views


@query("v1_best_views", f"""WITH {VIEWS}, a AS (SELECT query, work, view, round(max(s), 6) AS score FROM s GROUP BY ALL), b AS (SELECT query, work, max(score) AS score, arg_min(view, (-score, view)) AS view FROM a GROUP BY ALL)
SELECT query, work, view, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, work) AS rank FROM b) WHERE rank <= 5""")
def _(t: Tables):
    return v.best_views(*_views(t))


@query("v2_coverage", f"""WITH {VIEWS}, a AS (SELECT query, work, view, round(avg(s), 6) AS score FROM s GROUP BY ALL), b AS (SELECT query, work, max(score) AS score FROM a GROUP BY ALL)
SELECT query, work, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, work) AS rank FROM b) WHERE rank <= 5""")
def _(t: Tables):
    return v.coverage(*_views(t))


@query("v3_mutual_patches", """
WITH x AS (SELECT l_orderkey AS pair, l_suppkey % 6 AS q, l_partkey % 6 AS r, max(round(l_quantity / 50 + l_partkey / 1e6, 6)) AS s FROM lineitem GROUP BY ALL),
a AS (SELECT *, row_number() OVER w AS k, lead(s) OVER w AS second FROM x WINDOW w AS (PARTITION BY pair, q ORDER BY s DESC, q, r)), b AS (SELECT *, row_number() OVER (PARTITION BY pair, r ORDER BY s DESC, q, r) AS k FROM x)
SELECT a.pair, count(*) AS matches, round(quantile_cont(a.s, 0.5), 9) AS median FROM a JOIN b ON a.pair = b.pair AND a.q = b.q AND a.r = b.r AND b.k = 1 WHERE a.k = 1 AND a.s >= 0.72 AND a.s - coalesce(second, -1) >= 0.015 GROUP BY 1""")
def _(t: Tables):
    s = F.round(F.col("l_quantity") / 50 + F.col("l_partkey") / 1e6, 6)
    x = t.lineitem.groupBy(F.col("l_orderkey").alias("pair"), (F.col("l_suppkey") % 6).alias("q"), (F.col("l_partkey") % 6).alias("r")).agg(F.max(s).alias("s"))
    return v.mutual_patches(x)


@query("v4_choose_reference", 'SELECT o_custkey AS hit, arg_min(o_orderkey, (-(o_orderkey % 4), -o_totalprice, NOT (o_orderstatus = \'F\'), o_orderkey)) AS ref FROM orders GROUP BY 1')
def _(t: Tables):
    return v.choose_reference(t.orders.select(F.col("o_custkey").alias("hit"), F.col("o_orderkey").alias("ref"), (F.col("o_orderkey") % 4).alias("matches"), F.col("o_totalprice").alias("median"), (F.col("o_orderstatus") == "F").alias("same")))


KIND = "CASE WHEN p_partkey % 3 = 0 THEN 'whole' ELSE 'detail' END"


def _part_views(t: Tables):
    return t.part.select(F.col("p_partkey").alias("view"), F.col("p_brand").alias("work"), F.when(F.col("p_partkey") % 3 == 0, "whole").otherwise("detail").alias("kind"))


@query("v5_comparison_views", f"""
WITH h AS (SELECT s_suppkey AS query, p_brand AS work, p_partkey AS got, {KIND} AS gk FROM supplier JOIN part ON p_partkey = s_suppkey * 3 + 1), r AS (SELECT query, work, p_partkey AS view, row_number() OVER (PARTITION BY query, work ORDER BY p_partkey = got DESC, {KIND} <> gk DESC, p_partkey) AS k FROM h JOIN part ON p_brand = work)
SELECT query, work, view, k FROM r WHERE k <= 2""")
def _(t: Tables):
    hits = t.supplier.join(_part_views(t), F.col("view") == F.col("s_suppkey") * 3 + 1).select(F.col("s_suppkey").alias("query"), "work", "view", F.lit(1).alias("rank"))
    return v.comparison_views(hits, _part_views(t))


@query("v6_reference_views", f"SELECT p_brand AS work, p_partkey AS view, k FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY {KIND} = 'whole' DESC, p_partkey) AS k FROM part) WHERE k <= 2")
def _(t: Tables):
    return v.reference_views(t.part.select(F.col("p_brand").alias("work")), _part_views(t))


@query("v7_reference_problems", """
SELECT p_partkey AS ref, unnest(list_filter([CASE WHEN p_partkey % 4 = 0 THEN 'unknown work' END, CASE WHEN p_partkey % 5 = 0 THEN 'no provenance' END, CASE WHEN p_partkey % 6 = 0 THEN 'bad view' END, CASE WHEN p_partkey % 7 = 0 THEN 'changed file' END], lambda x: x IS NOT NULL)) AS problem FROM part""")
def _(t: Tables):
    p = F.col("p_partkey")
    refs = t.part.select(p.alias("ref"), p.alias("work"), F.when(p % 5 == 0, " ").otherwise("s").alias("source"), F.when(p % 6 == 0, "odd").otherwise("whole").alias("kind"), F.lit("h").alias("hash"), F.when(p % 7 == 0, "x").otherwise("h").alias("file_hash"))
    return v.manifest_problems(refs, t.part.where("p_partkey % 8 <> 0").select(p.alias("work"), F.when(p % 4 == 0, "archived").otherwise("active").alias("status")), ("whole", "detail"))


@query("v8_vector_problems", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'shape' WHEN vec_id % 3 = 1 THEN 'norm' END AS problem FROM embeddings")
def _(t: Tables):
    m = F.col("vec_id") % 3
    u = index.unit(F.col("embedding"))
    vec = F.when(m == 0, F.slice(u, 1, 10)).when(m == 1, F.transform(u, lambda x: x * 2)).otherwise(u)
    return t.embeddings.select("vec_id", v.vector_problem(vec, 64).alias("problem"))


def _features(t: Tables):
    """Two features an event: a visible match (a conflict on errors), and one that only one side shows."""
    odd = F.col("event_id") % 2 == 1

    def f(part, relation, seen, surface):
        return F.struct(part.alias("part"), relation.alias("relation"), F.lit(True).alias("distinctive"), F.lit(True).alias("query_visible"), seen.alias("reference_visible"), F.lit("a").alias("query_detail"), F.lit("b").alias("reference_detail"), F.lit("front").alias("query_surface"), surface.alias("reference_surface"), F.lit(True).alias("same_region"))

    first = f(F.lit("neck"), F.when(F.col("event_type") == "error", "visible_conflict").otherwise("visible_match"), F.lit(True), F.when(F.col("event_type") == "click", "back").otherwise("front"))
    second = f(F.when(odd, "base").otherwise("odd part"), F.lit("visible_match"), F.col("user_id") % 3 > 0, F.lit("front"))
    return t.events.select("event_id", "user_id", "event_type", F.array(first, second).cast(v.FEATURE).alias("features"))


SECOND = "user_id % 3 > 0"


@query("v10_visible", f"SELECT event_id, [CASE WHEN event_type = 'error' THEN 'different' ELSE 'match' END, CASE WHEN {SECOND} THEN 'match' ELSE 'not_visible' END] AS relations, ['neck', CASE WHEN event_id % 2 = 1 THEN 'base' ELSE 'parts' END] AS parts FROM events")
def _(t: Tables):
    n = _features(t).withColumn("n", v.normalised_visible(F.col("features"), ("neck", "base")))
    return n.select("event_id", F.transform("n", lambda x: x["relation"]).alias("relations"), F.transform("n", lambda x: x["part"]).alias("parts"))


@query("v11_same_surface", "SELECT event_id, [CASE WHEN event_type = 'click' THEN 'cannot_compare' WHEN event_type = 'error' THEN 'visible_conflict' ELSE 'visible_match' END, 'visible_match'] AS relations FROM events")
def _(t: Tables):
    return _features(t).select("event_id", F.transform(v.same_surface(F.col("features")), lambda x: x["relation"]).alias("relations"))


TIER = f"""t AS (SELECT user_id AS photo, event_id AS candidate, value AS score, CASE WHEN event_type = 'error' THEN 'different' WHEN event_type = 'purchase' OR event_id % 2 = 1 AND {SECOND} THEN 'agreement' ELSE 'partial' END AS reason FROM events),
r AS (SELECT photo, candidate, score, CASE reason WHEN 'agreement' THEN 'likely' WHEN 'partial' THEN 'uncertain' ELSE 'similar' END AS tier, CASE reason WHEN 'different' THEN 'visible_difference' ELSE reason END AS reason FROM t)"""


def _tiers(t: Tables):
    n = _features(t).withColumn("features", v.normalised_visible(F.col("features"), ("neck", "base")))
    n = n.join(t.events.select("event_id", F.col("value").alias("score")), "event_id")
    return v.tiers(n.select(F.col("user_id").alias("photo"), F.col("event_id").alias("candidate"), F.lit("same_work").alias("identity"), "features", (F.col("event_type") == "purchase").alias("label"), F.lit(False).alias("label_required"), "score"))


@query("v9_tiers", f"WITH {TIER} SELECT photo, candidate, score, tier, reason FROM r")
def _(t: Tables):
    return _tiers(t)


STATE = f"""{TIER}, k AS (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY score DESC, candidate) AS k FROM r WHERE tier <> 'similar'),
s AS (SELECT photo, list(candidate ORDER BY k) AS selected FROM k WHERE k <= 2 GROUP BY 1), l AS (SELECT photo, bool_or(tier = 'likely') AS likely FROM r GROUP BY 1),
st AS (SELECT photo, CASE WHEN selected IS NULL THEN 'no_reliable_match' WHEN likely AND len(selected) = 1 THEN 'likely_match' ELSE 'uncertain' END AS state, coalesce(selected, []) AS selected FROM l LEFT JOIN s USING (photo))"""


@query("v9_decisions", f"WITH {STATE} SELECT photo, state, selected FROM st")
def _(t: Tables):
    return v.decisions(_tiers(t))


@query("v12_number_clues", f"""WITH {STATE}, c AS (SELECT DISTINCT photo, p_partkey AS work FROM st JOIN part ON replace(p_brand, '#', '') = 'Brand' || (photo % 25) WHERE state <> 'likely_match')
SELECT photo, work, k FROM (SELECT photo, work, row_number() OVER (PARTITION BY photo ORDER BY work) AS k FROM c JOIN st USING (photo) WHERE NOT list_contains(selected, work)) WHERE k <= 2""")
def _(t: Tables):
    idx = index.key_index(t.part.withColumnRenamed("p_partkey", "work"), identifier_key(F.regexp_replace("p_brand", "#", " ")))
    photos = t.events.select(F.col("user_id").alias("photo")).distinct().withColumn("key", identifier_key(F.concat(F.lit("brand-"), (F.col("photo") % 25).cast("string"))))
    return v.number_clues(photos, idx, v.decisions(_tiers(t)))


@query("v13_inside", "SELECT event_id AS point, value / 100 + user_id / 150 < 1 AS inside FROM events")
def _(t: Tables):
    points = t.events.select(F.col("event_id").alias("point"), F.lit("r").alias("region"), (F.col("value") / 100).alias("x"), (F.col("user_id") / 150).alias("y"))
    triangle = t.region.where("r_regionkey = 0").select(F.lit("r").alias("region"), F.array(F.lit(-1e-9), F.lit(1.0), F.lit(-1e-9)).alias("xs"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("ys"))
    return v.inside_polygons(points, triangle)


@query("v14_support", """
WITH i AS (SELECT user_id AS query, event_id % 7 AS work, count(*) AS n, count(DISTINCT event_id % 5) AS c FROM events GROUP BY ALL)
SELECT query, work, CASE WHEN n >= 12 AND c >= 4 THEN n ELSE 0 END AS support, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN n >= 12 AND c >= 4 THEN n ELSE 0 END DESC, work) AS rank FROM i""")
def _(t: Tables):
    i = t.events.select(F.col("user_id").alias("query"), (F.col("event_id") % 7).alias("work"), (F.col("event_id") % 5).alias("cell"))
    return v.rerank_support(i.select("query", "work", F.col("work").alias("pos")).distinct(), i)


@query("v15_aliases", "SELECT l_orderkey AS request, l_partkey AS candidate, true AS restored FROM lineitem GROUP BY 1, 2")
def _(t: Tables):
    c = t.lineitem.select(F.col("l_orderkey").alias("request"), F.col("l_partkey").alias("candidate"))
    c = c.repartition(tasks_for(c), "request").distinct()
    named = v.aliased(c)
    good, _bad = v.restored(named.select("request", "alias"), named)
    return good.select("request", "candidate", F.lit(True).alias("restored"))
