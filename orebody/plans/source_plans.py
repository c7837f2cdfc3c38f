"""Sources (S), chunks (C), versions (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as c
from ..operators import versions as v
from ..operators.expand import tasks_for
from ..operators.memory import valid_sources
from ..session import new_path
from ..sources import catalogue as cat
from ..sources import tables as tab
from ..sources.stored_table import StoredTable, drain_into
from ..streaming.jobs import table_stream
from .registry import Tables, query


@query("s1_catalogue", """
SELECT 'work-' || p_partkey AS id, 'Title: ' || p_name || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Medium: ' || p_type || chr(10) END || 'Size: ' || p_size AS content FROM part""")
def _(t: Tables):
    raw = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.concat(F.lit("<b>"), "p_name", F.lit("</b>")).alias("title"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type")).alias("medium"), F.col("p_size").alias("size")))
    w = cat.works_from_json(raw, {"title": "Title", "medium": "Medium", "size": "Size"}, "work-")
    return t.part.select(w.alias("w")).select("w.id", "w.content")


@query("s2_objects", """
WITH o AS (SELECT c_nationkey AS id, list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS seg, min(c_custkey) AS first FROM customer GROUP BY 1)
SELECT id, 'Maker: ' || array_to_string(seg, '; ') || '; Guild' || chr(10) || 'Date: ' || first || chr(10) || 'Place: ' AS content FROM o""")
def _(t: Tables):
    rows = t.customer.groupBy(F.col("c_nationkey").alias("id")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("persons"), F.array(F.min("c_custkey").cast("string"), F.lit("")).alias("dates"))
    full = rows.withColumn("organisations", F.array(F.lit("Guild"))).withColumn("places", F.array().cast("array<string>"))
    return cat.objects_from_nested(full).select("id", "content")


@query("s3_extended", """
WITH n AS (SELECT s_suppkey AS id, 'c' || (s_nationkey % 3) AS category FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 7 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS k, count(*) OVER (PARTITION BY category) AS n FROM n),
c AS (SELECT category, max(n) AS n FROM k GROUP BY category),
q0 AS (SELECT least(n, ceil(31 / 3.0)) AS q FROM c WHERE category = 'c0'), q1 AS (SELECT least(n, ceil((31 - (SELECT q FROM q0)) / 2.0)) AS q FROM c WHERE category = 'c1'),
q2 AS (SELECT least(n, 31 - (SELECT q FROM q0) - (SELECT q FROM q1)) AS q FROM c WHERE category = 'c2')
SELECT id, category FROM k WHERE k <= CASE category WHEN 'c0' THEN (SELECT q FROM q0) WHEN 'c1' THEN (SELECT q FROM q1) ELSE (SELECT q FROM q2) END""")
def _(t: Tables):
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("i"), F.col("s_suppkey").cast("string")).alias("image"), F.concat(F.lit("h"), F.col("s_suppkey").cast("string")).alias("hash"), F.concat(F.lit("c"), (F.col("s_nationkey") % 3).cast("string")).alias("category"), F.col("s_suppkey").alias("pos"))
    base = s.where("id % 4 = 0").unionByName(s.where("id % 7 = 0").withColumn("id", F.col("id") + 1_000_000))
    return cat.extended(base, s, 31).select("id", "category")


@query("s4_html_blocks", r"""
WITH inside AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body, len(regexp_extract_all(html, '<li>')) AS items FROM pages),
p AS (SELECT page_id, items, unnest(string_split_regex(body, '</?(p|h1)>')) AS x FROM inside)
SELECT page_id, count(*) FILTER (trim(regexp_replace(x, '<[^>]*>', ' ', 'g')) <> '') + any_value(items) AS blocks FROM p GROUP BY page_id""")
def _(t: Tables):
    return cat.html_blocks(t.pages).groupBy("page_id").agg(F.count("*").alias("blocks"))


def _structured(t: Tables):
    """Documents whose lines are made into headings, items and empty lines by their place."""
    part = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 6 == 0, F.concat(F.repeat(F.lit("#"), (i % 3 + 1).cast("int")), F.lit(" "), F.substring(x, 1, 20))).when(i % 6 == 3, F.concat(F.lit("- "), x)).when(i % 6 == 5, F.lit("")).otherwise(x))
    return t.documents.select("doc_id", F.array_join(part, "\n").alias("text"))


@query("s5_markdown_blocks", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
k AS (SELECT doc_id, i, CASE WHEN i % 6 = 0 THEN 'heading' WHEN i % 6 = 3 THEN 'list_item' WHEN i % 6 = 5 OR trim(x) = '' THEN 'empty' ELSE 'text' END AS kind FROM l),
b AS (SELECT doc_id, i, kind, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS was FROM k)
SELECT doc_id, count(*) FILTER (kind = 'heading') AS headings, count(*) FILTER (kind = 'list_item') AS items, count(*) FILTER (kind = 'text' AND (was IS NULL OR was IN ('heading', 'empty'))) AS paragraphs FROM b GROUP BY doc_id""")
def _(t: Tables):
    n = lambda k: F.count(F.when(F.col("type") == k, 1))
    return cat.markdown_blocks(_structured(t)).groupBy("doc_id").agg(n("heading").alias("headings"), n("list_item").alias("items"), n("paragraph").alias("paragraphs"))


def _chapters(t: Tables):
    part = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 1, F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("章 "), F.substring(x, 1, 20))).otherwise(x))
    return t.documents.select("doc_id", F.array_join(part, "\n").alias("text"))


@query("s6_text_blocks", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
m AS (SELECT doc_id, CASE WHEN i % 4 = 1 THEN '第' || (i + 1) || '章 ' || substr(x, 1, 20) ELSE regexp_replace(x, '^\s+|\s+$', '', 'g') END AS x, i FROM l)
SELECT doc_id, count(*) FILTER (x <> '') AS blocks, count(*) FILTER (x <> '' AND length(x) <= 60 AND regexp_matches(x, '^(第[一二三四五六七八九十百0-9]+[章节部分篇编]|[一二三四五六七八九十]+、|[0-9]+[.、．]\s*[^0-9])')) AS headings FROM m GROUP BY doc_id""")
def _(t: Tables):
    return cat.text_blocks(_chapters(t)).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count(F.when(F.col("type") == "heading", 1)).alias("headings"))


@query("s7_scan_files", """
SELECT '/base/' || source || '/' || doc_id || '.txt' AS path, 'dept_' || source AS dept FROM documents WHERE doc_id % 3 <> 0 AND source IN ('src1', 'src2', 'src0')""")
def _(t: Tables):
    path = F.concat(F.lit("/base/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".bin").otherwise(".txt"))
    mapping = t.documents.where("source in ('src0', 'src1', 'src2')").select(F.col("source").alias("folder"), F.concat(F.lit("dept_"), "source").alias("dept")).distinct()
    return cat.scan_files(t.documents.select(path.alias("path")), mapping, (".txt", ".md"))


@query("s8_find", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def _(t: Tables):
    return tab.find(t.orders, {"o_orderstatus": "F"}, "o_orderdate", 50, "o_orderkey").select("o_orderkey", "o_orderdate")


@query("s9_upsert", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def _(t: Tables):
    base = t.customer.select(F.col("c_custkey").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), F.col("c_acctbal").alias("value"))
    return tab.upsert(base, t.events.select("user_id", "event_id", "value"), "user_id", "event_id").select("user_id", "value")


@query("s9_stored_upsert", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def _(t: Tables):
    table = StoredTable(t.spark, new_path(t.spark, "s9"), "user_id long, event_id long, value double", F.pmod(F.xxhash64("user_id"), F.lit(16)))
    table.append(t.customer.select(F.col("c_custkey").cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), F.col("c_acctbal").cast("double").alias("value")))
    rows = table_stream(t.spark, f"{t.folder}/events.parquet").select("user_id", "event_id", "value")
    drain_into(rows, new_path(t.spark, "s9-checkpoint"), lambda batch, n: table.upsert(batch, "user_id", "event_id", n))
    return table.read().select("user_id", "value")


@query("s10_insert_unique", "SELECT event_id FROM events WHERE user_id < 40 OR event_id NOT IN (SELECT min(event_id) FROM events WHERE user_id >= 40 GROUP BY user_id)")
def _(t: Tables):
    base = t.customer.where("c_custkey < 40").select(F.col("c_custkey").alias("user_id"), F.lit(-1).cast("long").alias("event_id"))
    return tab.insert_unique(base, t.events.select("user_id", "event_id"), "user_id", "event_id")[1].select("event_id")


@query("s11_incremented", "SELECT coalesce(c_custkey, user_id) AS user_id, coalesce(c_nationkey, 0) + coalesce(d, 0)::BIGINT AS n FROM customer FULL JOIN (SELECT user_id, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) AS d FROM events GROUP BY 1) ON c_custkey = user_id")
def _(t: Tables):
    base = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("n"))
    return tab.incremented(base, t.events.select("user_id", F.when(F.col("event_type") == "error", -1).otherwise(1).alias("delta")), "user_id")


@query("s12_manifest", "SELECT 'orders' AS name, count(*) AS rows, true AS same FROM orders UNION ALL SELECT 'customer', count(*), false FROM customer")
def _(t: Tables):
    before = tab.manifest({"orders": t.orders, "customer": t.customer})
    after = tab.manifest({"orders": t.orders.repartition(3), "customer": t.customer.withColumn("c_acctbal", F.col("c_acctbal") + 1)})
    return before.alias("b").join(after.alias("a"), "name").select("name", F.col("b.rows").alias("rows"), (F.col("a.digest") == F.col("b.digest")).alias("same"))


@query("s13_corpus_problems", """
WITH w AS (SELECT doc_id % 900 AS work, CASE WHEN source = 'src2' THEN 'archived' ELSE 'active' END AS status FROM documents)
SELECT work, 'duplicate' AS problem FROM w GROUP BY work HAVING count(*) > 1 UNION ALL SELECT work, 'inactive' FROM w WHERE status <> 'active'""")
def _(t: Tables):
    w = t.documents.select((F.col("doc_id") % 900).alias("work"), F.when(F.col("source") == "src2", "archived").otherwise("active").alias("status"), F.sha2("text", 256).alias("digest"))
    return tab.corpus_problems(w, w)[0]


@query("s13_corpus_hash", """
WITH g AS (SELECT substr(d, 1, 3) AS first, sha256(string_agg(d, '' ORDER BY d)) AS h FROM (SELECT sha256(p_name || p_partkey) AS d FROM part) GROUP BY 1)
SELECT sha256(string_agg(h, '' ORDER BY h)) AS corpus_hash FROM g""")
def _(t: Tables):
    parts = t.part.select(F.sha2(F.concat("p_name", F.col("p_partkey").cast("string")), 256).alias("digest"))
    return tab.corpus_problems(t.part.select(F.col("p_partkey").alias("work"), F.lit("active").alias("status")), parts)[1]


@query("c1_sections", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
h AS (SELECT doc_id, pos, x, CASE WHEN pos % 5 = 2 THEN 1 + (pos * 7) % 3 END AS lv FROM l),
w AS (SELECT *, count(lv) OVER o AS section, last_value(lv IGNORE NULLS) OVER o AS now,
  last_value(CASE WHEN lv <= 1 THEN (lv, x) END IGNORE NULLS) OVER o AS a, last_value(CASE WHEN lv <= 2 THEN (lv, x) END IGNORE NULLS) OVER o AS b, last_value(CASE WHEN lv <= 3 THEN (lv, x) END IGNORE NULLS) OVER o AS c
  FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT doc_id, pos::INT AS pos, section, md5(coalesce(array_to_string(([CASE WHEN a[1] = 1 THEN a[2] ELSE '' END, CASE WHEN b[1] = 2 THEN b[2] ELSE '' END, CASE WHEN c[1] = 3 THEN c[2] ELSE '' END])[1:coalesce(now, 0)], '>'), '')) AS path FROM w""")
def _(t: Tables):
    l = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    heading = F.col("pos") % 5 == 2
    blocks = l.select("doc_id", "pos", F.when(heading, "heading").otherwise("paragraph").alias("type"), F.when(heading, 1 + (F.col("pos") * 7) % 3).otherwise(0).alias("level"), "text")
    return c.sections(blocks).select("doc_id", "pos", "section", F.md5(F.array_join("path", ">")).alias("path"))


@query("c2_units", r"SELECT doc_id, count(*) AS units FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE regexp_replace(x, '^\s+|\s+$', '', 'g') <> '' GROUP BY doc_id")
def _(t: Tables):
    return cat.text_blocks(t.documents).groupBy("doc_id").agg(F.count("*").alias("units"))


@query("c3_hard_split", r"""
WITH d AS (SELECT doc_id, replace(text, '. ', '。') AS x FROM documents WHERE text <> ''),
p AS (SELECT doc_id, CASE WHEN length(x) <= 600 THEN [x] ELSE regexp_extract_all(x, '(?s).{299,}?[。！？；\n]|.+$') END AS cut FROM d),
q AS (SELECT doc_id, unnest(cut) AS x FROM p)
SELECT doc_id, sum(greatest(1, ceil(length(x) / 600.0)))::BIGINT AS pieces, sum(length(x))::BIGINT AS chars FROM q GROUP BY doc_id""")
def _(t: Tables):
    text = F.replace(F.col("text"), F.lit(". "), F.lit("。"))
    pieces = c.hard_split(text)
    return t.documents.where("text <> ''").select("doc_id", F.size(pieces).cast("long").alias("pieces"), F.aggregate(pieces, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chars"))


@query("c4_c6_chunks")
def _(t: Tables):
    return c.chunk_blocks(cat.text_blocks(_chapters(t))).drop("content")


@query("c7_catalogue_chunks", r"SELECT doc_id AS work, length(regexp_replace(text, '\s+', '', 'g')) AS chars FROM documents")
def _(t: Tables):
    works = t.documents.select(F.col("doc_id").alias("work"), F.col("source").alias("title"), F.col("text").alias("content"))
    made = c.catalogue_chunks(works)
    n = F.sum(F.length(F.regexp_replace("piece", r"\s+", "")))
    return t.documents.select(F.col("doc_id").alias("work")).join(made.groupBy("work").agg(n.alias("n")), "work", "left").select("work", F.coalesce("n", F.lit(0)).alias("chars"))


def _labelled(t: Tables):
    content = F.concat(F.lit("Title: "), "p_name", F.lit("\nMuseum number: "), "p_brand", F.lit("\nbriefDescription: A "), "p_name", F.lit(" of type "), "p_type", F.when(F.col("p_partkey") % 4 == 0, "").otherwise("\nMore about it"))
    return c.catalogue_chunks(t.part.select(F.col("p_partkey").alias("work"), F.col("p_name").alias("title"), content.alias("content")))


@query("c8_dense_views", """
WITH l AS (SELECT p_partkey AS work, p_name AS title, unnest(['Title: ' || p_name, 'Museum number: ' || p_brand, 'briefDescription: A ' || p_name || ' of type ' || p_type, CASE WHEN p_partkey % 4 > 0 THEN 'More about it' END]) AS x, unnest([0, 1, 2, 3]) AS chunk FROM part)
SELECT work, chunk, 'original' AS view, title || chr(10) || x AS content FROM l WHERE x IS NOT NULL
UNION ALL SELECT work, chunk, 'filtered', title || chr(10) || x FROM l WHERE chunk > 1 AND x IS NOT NULL
UNION ALL SELECT work, chunk, 'normalized', title || chr(10) || replace(x, 'briefDescription: ', '') FROM l WHERE chunk > 1 AND x IS NOT NULL""")
def _(t: Tables):
    return c.dense_views(_labelled(t), ("Title", "Museum number"), ("briefDescription",))


@query("c9_administrative_view", """
SELECT work, chunk, title || chr(10) || x AS content FROM (SELECT p_partkey AS work, p_name AS title, unnest(['Title: ' || p_name, 'briefDescription: A ' || p_name || ' of type ' || p_type, CASE WHEN p_partkey % 4 > 0 THEN 'More about it' END]) AS x, unnest([0, 2, 3]) AS chunk FROM part) WHERE x IS NOT NULL""")
def _(t: Tables):
    return c.administrative_view(_labelled(t), ("Museum number",))


@query("c10_flattened_fields", "SELECT p_partkey AS work, array_to_string([p_brand, p_type, p_name], ' ') AS text FROM part")
def _(t: Tables):
    return t.part.select(F.col("p_partkey").alias("work"), F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("text"))


@query("c11_text_budget", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
b AS (SELECT doc_id, x, i, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length(x) AS before FROM l)
SELECT doc_id, i::INT AS chunk, md5(substr(x, 1, (6000 - before)::INT)) AS digest FROM b WHERE before < 6000""")
def _(t: Tables):
    l = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk", "content"))
    return c.text_budget(l).select("doc_id", "chunk", F.md5("content").alias("digest"))


@query("c12_pack_context")
def _(t: Tables):
    l = t.documents.select(F.col("doc_id").alias("request"), F.posexplode(F.split("text", "\n")).alias("priority", "text"))
    return c.pack_context(l, 2000).select("request", F.length("passage").alias("chars"), F.size("included").alias("included"), F.size("omitted").alias("omitted"))


@query("c13_evidence_passage", "SELECT p_partkey AS work, array_to_string([p_name, 'Type: ' || p_type, p_brand], chr(10)) AS passage FROM part")
def _(t: Tables):
    x = c.evidence_passage(F.col("p_name"), F.array(F.concat(F.lit("Type: "), "p_type"), F.col("p_name")), F.array("p_brand", "p_brand"))
    return t.part.select(F.col("p_partkey").alias("work"), x.alias("passage"))


def _docs(t: Tables):
    return t.documents.select(F.col("doc_id").alias("doc"), F.col("source").alias("dept"), F.md5("text").alias("hash"), F.col("n_chars").alias("created_at"), F.concat(F.lit("t"), (F.col("doc_id") % 40).cast("string")).alias("title"))


@query("d1_accepted", """
WITH d AS (SELECT doc_id AS doc, source AS dept, md5(text) AS hash, n_chars AS created_at FROM documents), s AS (SELECT dept, hash FROM d WHERE doc % 5 = 0 AND doc % 10 <> 0)
SELECT doc, dept FROM (SELECT *, row_number() OVER (PARTITION BY dept, hash ORDER BY created_at, doc) AS k FROM d WHERE doc % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.dept = d.dept AND s.hash = d.hash)) WHERE k = 1""")
def _(t: Tables):
    d = _docs(t)
    stored = d.where("doc % 5 = 0").withColumn("status", F.when(F.col("doc") % 10 == 0, "deleted").otherwise("active"))
    return v.accepted(d.where("doc % 5 <> 0"), stored).select("doc", "dept")


CHAIN = "SELECT doc_id AS doc, source AS dept, 't' || (doc_id % 40) AS title, n_chars AS created_at, md5(text) AS hash FROM documents"


@query("d2_chained", f"WITH d AS ({CHAIN}) SELECT doc, '1.' || (row_number() OVER w - 1) AS version, lag(doc) OVER w AS supersedes FROM d WINDOW w AS (PARTITION BY dept, title ORDER BY created_at, doc)")
def _(t: Tables):
    return v.chained(_docs(t)).select("doc", "version", "supersedes")


@query("d2_next_version", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey || '.' || (s_suppkey + 1) ELSE '1.0' END AS next FROM supplier")
def _(t: Tables):
    now = F.when(F.col("s_suppkey") % 3 == 0, F.concat_ws(".", "s_nationkey", "s_suppkey")).when(F.col("s_suppkey") % 3 == 1, "v2").otherwise("")
    return t.supplier.select("s_suppkey", v.next_version(now).alias("next"))


@query("d3_activated", f"WITH d AS ({CHAIN}) SELECT doc, CASE WHEN row_number() OVER (PARTITION BY dept, title ORDER BY created_at DESC, doc DESC) = 1 THEN 'active' ELSE 'archived' END AS status FROM d")
def _(t: Tables):
    return v.activated(_docs(t)).select("doc", "status")


@query("d4_d5_searchable", f"WITH d AS ({CHAIN}), a AS (SELECT doc, row_number() OVER (PARTITION BY dept, title ORDER BY created_at DESC, doc DESC) AS k FROM d) SELECT doc_id AS doc, len(string_split(text, chr(10)))::BIGINT AS chunks FROM documents JOIN a ON doc = doc_id WHERE k = 1")
def _(t: Tables):
    chunks = t.documents.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("chunk", "text"))
    return v.searchable(chunks, v.activated(_docs(t))).groupBy("doc").agg(F.count("*").alias("chunks"))


@query("d6_fresh", """
WITH r AS (SELECT user_id AS query, event_id % 500 AS work, min(event_id) AS pos FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT query, work, pos FROM r JOIN documents ON doc_id = work WHERE source <> 'src1' AND work % 6 <> 0""")
def _(t: Tables):
    works = t.documents.select(F.col("doc_id").alias("work"), F.concat(F.lit("h"), F.col("doc_id").cast("string")).alias("hash"), F.when(F.col("source") == "src1", "archived").otherwise("active").alias("status"))
    r = t.events.where("event_type = 'view'").select(F.col("user_id").alias("query"), (F.col("event_id") % 500).alias("work"), F.col("event_id").alias("pos"))
    return v.fresh(r.withColumn("hash", F.when(F.col("work") % 6 == 0, "old").otherwise(F.concat(F.lit("h"), F.col("work").cast("string")))), works)


@query("d7_references", """
SELECT o_orderkey AS fact, count(*) AS n_sources, count(*) FILTER (o_orderstatus <> 'P' AND l_linenumber < 6 AND l_returnflag <> 'A') AS n_valid FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def _(t: Tables):
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    n = tasks_for(t.lineitem, t.orders)
    chunks = t.lineitem.where("l_linenumber < 6").select(key.alias("chunk"), F.col("l_orderkey").alias("doc")).repartition(n, "chunk").distinct()
    docs = t.orders.select(F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("dept"), F.lit("1.0").alias("version"), F.when(F.col("o_orderstatus") == "P", "archived").otherwise("active").alias("status"))
    lines = t.lineitem.repartition(n, "l_orderkey").join(t.orders.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    facts = lines.select(F.col("o_orderkey").alias("fact"), key.alias("chunk"), F.col("o_orderpriority").alias("dept"), F.when(F.col("l_returnflag") == "A", "2.0").when(F.col("l_returnflag") == "R", "1.0").alias("version"))
    return valid_sources(facts, docs, chunks)


@query("d8_leaks", "SELECT doc_id AS item FROM documents d WHERE doc_id % 3 = 0 AND EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 3 <> 0 AND e.text = d.text)")
def _(t: Tables):
    d = t.documents.select(F.col("doc_id").alias("item"), F.md5("text").alias("hash"))
    return v.leaks(d.where("item % 3 <> 0"), d.where("item % 3 = 0")).select("item")
