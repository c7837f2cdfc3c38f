"""Cleaning, keys and predicates (P), term statistics (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import index
from .registry import Tables, query

FULL, HALF = fn.FULL_WIDTH, fn.HALF_WIDTH.replace("'", "''")
UNCERTAIN = "unknown|attributed|after|possibly|probably|workshop|circle|school|style|manner"
#: Tokens of documents in DuckDB: doc, source, w.
WORDS = "SELECT doc_id AS doc, source, regexp_extract_all(lower(text), '[一-鿿]|[a-z0-9]+') AS w FROM documents"
POSTS = f"""d AS ({WORDS}),
e AS (SELECT doc, source, len(w) AS len, unnest(w) AS term FROM d WHERE len(w) > 0),
p AS (SELECT doc, source, len, term, count(*) AS tf FROM e GROUP BY ALL)"""


@query("p1_half_width", f"SELECT doc_id, md5(translate(translate(text, 'aeiou.,', 'ａｅｉｏｕ．，'), '{FULL}', '{HALF}')) AS digest FROM documents")
def _(t: Tables):
    wide = F.translate("text", "aeiou.,", "ａｅｉｏｕ．，")
    return t.documents.select("doc_id", F.md5(fn.half_width(wide)).alias("digest"))


#: Noise for the texts: no-break and ideographic spaces inside and at the end.
@query("p2_squeeze", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', '.' || chr(9) || chr(160) || ' ') || chr(160) || chr(12288), '[ \t\x{A0}　]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
  '^[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')) AS digest FROM documents""")
def _(t: Tables):
    noisy = F.concat(F.regexp_replace("text", r"\. ", ".\t\u00a0 "), F.lit("\u00a0\u3000"))
    return t.documents.select("doc_id", F.md5(fn.squeeze(noisy)).alias("digest"))


LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)"


def _lines(t: Tables):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


@query("p3_noise", rf"WITH {LINES_SQL} SELECT doc_id, count(*) AS kept FROM l WHERE length(line) >= 2 AND NOT regexp_matches(line, '^\s*[0-9]+\s*$') AND NOT regexp_matches(line, '^\s*第\s*[0-9]+\s*页\s*共\s*[0-9]+\s*页\s*$') AND NOT regexp_matches(line, '^\s*(版权所有|内部资料|严禁外传)\s*$') GROUP BY doc_id")
def _(t: Tables):
    return _lines(t).where(~fn.is_noise(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("p4_rebuild", rf"WITH {LINES_SQL} SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM l WHERE length(line) >= 2 AND NOT regexp_matches(line, '^\s*[0-9]+\s*$') GROUP BY doc_id")
def _(t: Tables):
    kept = _lines(t).where(~fn.is_noise(F.col("line")))
    from ..operators.cleaning import rebuild

    return rebuild(kept).select("doc_id", F.md5("text").alias("digest"))


@query("p5_metadata", """
SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS doc_type, ['k' || user_id, event_type] AS keywords,
       CASE WHEN event_type IN ('signup', 'error') THEN [event_type] ELSE ['all'] END AS scope, []::VARCHAR[] AS cross_refs FROM events""")
def _(t: Tables):
    from ..operators.cleaning import normalise_metadata

    raw = F.to_json(F.struct(F.col("event_type").alias("doc_type"), F.array(F.concat(F.lit("k"), F.col("user_id").cast("string")), F.col("event_type")).alias("keywords"), F.array("event_type").alias("applicable_scope")))
    meta = normalise_metadata(raw, ("view", "click", "other"), ("signup", "error", "all"))
    return t.events.select("event_id", meta.alias("m")).select("event_id", "m.doc_type", "m.keywords", "m.scope", "m.cross_refs")


@query("p6_identifier", r"""
WITH v AS (SELECT p_partkey, ' ' || replace(p_brand, '#', ' no.') || '–' || p_size || CASE WHEN p_partkey % 3 = 0 THEN ' ?' WHEN p_partkey % 3 = 1 THEN ' (ａ)' ELSE '' END AS raw FROM part),
f AS (SELECT p_partkey, upper(trim(replace(replace(replace(raw, '–', '-'), '（', '('), 'ａ', 'a'))) AS x FROM v)
SELECT p_partkey, CASE WHEN regexp_full_match(x, '[A-Z0-9\s.\-:/,()&]+') THEN regexp_replace(x, '[\s.\-:/,()&]', '', 'g') END AS key FROM f""")
def _(t: Tables):
    raw = F.concat(F.lit(" "), F.regexp_replace("p_brand", "#", " no."), F.lit("–"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, " ?").when(F.col("p_partkey") % 3 == 1, " (ａ)").otherwise(""))
    return t.part.select("p_partkey", fn.identifier_key(raw).alias("key"))


@query("p7_name_key", r"""
WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' (Dutch, 1801 - 1880)' WHEN 1 THEN 'attributed to ' || p_name WHEN 2 THEN p_name || ' 3' ELSE upper(p_name) END AS raw, p_name FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 3) THEN list_sort(string_split(lower(p_name), ' ')) END AS key FROM v""")
def _(t: Tables):
    m = F.col("p_partkey") % 4
    raw = F.when(m == 0, F.concat("p_name", F.lit(" (Dutch, 1801 - 1880)"))).when(m == 1, F.concat(F.lit("attributed to "), "p_name")).when(m == 2, F.concat("p_name", F.lit(" 3"))).otherwise(F.upper("p_name"))
    return t.part.select("p_partkey", fn.name_key(raw, UNCERTAIN).alias("key"))


@query("p8_date_key", """
SELECT o_orderkey, (o_orderkey % 4 = 1) AS approx, CASE WHEN o_orderkey % 4 < 3 THEN year(o_orderdate) END::INT AS "start",
       CASE WHEN o_orderkey % 4 = 2 THEN year(o_orderdate) + 2 END::INT AS "end" FROM orders""")
def _(t: Tables):
    y, m = F.year("o_orderdate"), F.col("o_orderkey") % 4
    raw = F.when(m == 0, y.cast("string")).when(m == 1, F.concat(F.lit("ca. "), y)).when(m == 2, F.concat(y, F.lit(" – "), y + 2)).otherwise(F.concat(F.lit("about "), y))
    k = t.orders.select("o_orderkey", fn.date_key(raw).alias("k"))
    return k.select("o_orderkey", F.coalesce("k.approx", F.lit(False)).alias("approx"), F.col("k.start").alias("start"), F.col("k.end").alias("end"))


@query("p9_label_lines", "SELECT p_partkey, label, value FROM (SELECT p_partkey, unnest(['Brand', 'Type', 'Size']) AS label, unnest([p_brand, p_type, p_size::VARCHAR]) AS value FROM part)")
def _(t: Tables):
    from ..operators.cleaning import label_lines

    content = F.concat_ws("\n", F.concat(F.lit(" Brand : "), "p_brand"), F.concat(F.lit("Type:"), "p_type"), F.lit("no label"), F.concat(F.lit("Size: "), F.col("p_size").cast("string")), F.lit("Empty:"))
    return label_lines(t.part.select("p_partkey", content.alias("content")), ("Brand", "Type", "Size", "Empty"), "p_partkey").select("p_partkey", "label", "value")


@query("p10_lexical_query", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN array_to_string(list_filter(regexp_extract_all(lower('找 ' || text), '[一-鿿]|[a-z0-9]+'), lambda x: x NOT IN ('找', 'the', 'of')), ' ') ELSE text END AS q FROM benchmark")
def _(t: Tables):
    raw = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("找 "), "text")).otherwise(F.col("text"))
    return t.benchmark.select("item_id", fn.lexical_query(raw, ("找", "the", "of")).alias("q"))


@query("p11_coverage_form", r"SELECT doc_id, md5(regexp_replace(replace(lower(text), '–', '-'), '\s+', '', 'g')) AS digest FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.md5(fn.coverage_form(F.col("text"))).alias("digest"))


@query("p12_repeated_title", r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)
SELECT doc_id, md5(array_to_string(list_concat(x[1:1], list_filter(x[2:], lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g') <> regexp_replace(x[1], '^\s+|\s+$', '', 'g'))), chr(10))) AS digest FROM l""")
def _(t: Tables):
    title = fn.strip(F.split("text", "\n")[0])
    return t.documents.select("doc_id", F.md5(fn.without_title(F.col("text"), title)).alias("digest"))


@query("p13_sensitive", "SELECT event_id, event_type = 'error' OR (props LIKE '%: 7}%') AS sensitive FROM events")
def _(t: Tables):
    key = F.when(F.col("event_type") == "error", "Health").otherwise(F.col("event_type"))
    value = F.when(F.col("props").contains(": 7}"), "my PASSWORD").otherwise(F.col("props"))
    return t.events.select("event_id", fn.is_sensitive(key, value).alias("sensitive"))


@query("p14_user_facts", "SELECT event_id FROM events WHERE user_id = 8 AND event_type <> 'error' AND ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-20'")
def _(t: Tables):
    from ..operators.memory import user_readable

    facts = t.events.select("event_id", F.col("user_id").alias("owner"), F.when(F.col("event_type") == "error", "candidate").otherwise("active").alias("status"), (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"))
    return facts.where(user_readable(F.lit(8), F.lit("2024-01-20").cast("timestamp"))).select("event_id")


@query("p15_org_facts", """
SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 3 <> 1
  AND o_orderdate <= DATE '1998-06-01' AND (o_orderkey % 2 = 0 OR o_orderdate + INTERVAL 400 DAY >= TIMESTAMP '1998-06-01')""")
def _(t: Tables):
    from ..operators.memory import org_readable

    facts = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "archived").otherwise("active").alias("status"), F.lit(True).alias("approved"), F.col("o_orderpriority").alias("dept"),
        F.when(F.col("o_orderkey") % 3 == 0, F.array()).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("admin"))).otherwise(F.array(F.lit("clerk"), F.lit("admin"))).cast("array<string>").alias("roles"),
        F.col("o_orderdate").alias("effective_from"), F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")).alias("effective_to"), F.lit(None).cast("timestamp").alias("expires_at"),
    )
    return facts.where(org_readable(("1-URGENT", "2-HIGH"), "clerk", F.lit("1998-06-01").cast("timestamp"))).select("o_orderkey")


@query("p16_scope", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 3")
def _(t: Tables):
    from ..operators.memory import in_scope

    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("dept"), F.when(F.col("c_nationkey") == 3, "global").otherwise("dept").alias("scope"))
    return rows.where(in_scope("BUILDING", with_global=True)).select("c_custkey")


@query("p17_export", "SELECT event_id, event_type, value FROM events")
def _(t: Tables):
    from ..operators.runlog import allowed

    return allowed(t.events, ("event_id", "event_type", "value", "unknown_column"))


@query("t1_tokens", f"WITH d AS ({WORDS}) SELECT doc, len(w)::INT AS n, md5(array_to_string(w, ' ')) AS digest FROM d")
def _(t: Tables):
    return t.documents.select(F.col("doc_id").alias("doc"), F.size(fn.tokens(F.col("text"))).alias("n"), F.md5(F.array_join(fn.tokens(F.col("text")), " ")).alias("digest"))


@query("t2_postings", f"WITH {POSTS} SELECT doc, count(*) AS terms, sum(tf)::BIGINT AS len, max(tf) AS max_tf FROM p GROUP BY doc")
def _(t: Tables):
    return index.postings(t.documents).groupBy("doc").agg(F.count("*").alias("terms"), F.sum("tf").alias("len"), F.max("tf").alias("max_tf"))


@query("t2_statistics", f"WITH {POSTS}, f AS (SELECT term, count(*) AS df FROM p GROUP BY term), c AS (SELECT count(*) AS n, round(avg(len), 6) AS avg_len FROM (SELECT DISTINCT doc, len FROM p)) SELECT term, df, n, avg_len FROM f, c")
def _(t: Tables):
    terms = index.term_index(t.documents)
    stats = index.index_collection(terms).select("n", F.round("avg_len", 6).alias("avg_len"))
    # A word counts once a document: no frequency in it is needed, so nothing is shuffled but the partial counts.
    df = terms.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(stats))


@query("t3_incremental", f"WITH {POSTS} SELECT term, count(*) AS df FROM p WHERE source <> 'src3' GROUP BY term")
def _(t: Tables):
    d = t.documents
    terms = index.term_index(d, keep=("source",))
    df = lambda rows: index.document_frequency(index.index_postings(rows))
    base, late, gone = terms.where("source <> 'src5'"), terms.where("source = 'src5'"), terms.where("source = 'src3'")
    return index.updated_frequency(df(base), df(late), df(gone))


FIELDS_SQL = "fl AS (SELECT p_partkey AS work, unnest(['name', 'brand', 'type']) AS field, unnest([p_name, p_brand, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END]) AS text FROM part), fw AS (SELECT work, field, regexp_extract_all(lower(text), '[一-鿿]|[a-z0-9]+') AS w FROM fl)"


def part_fields(t: Tables):
    kind = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_type"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("text")) for n, c in (("name", F.col("p_name")), ("brand", F.col("p_brand")), ("type", kind))]))
    return t.part.select(F.col("p_partkey").alias("work"), each.alias("f")).select("work", "f.field", "f.text")


@query("t4_field_lengths", f"WITH {FIELDS_SQL} SELECT field, round(sum(len(w)) / (SELECT count(DISTINCT work) FROM fw), 6) AS avg_len, (SELECT count(DISTINCT work) FROM fw) AS n FROM fw GROUP BY field")
def _(t: Tables):
    return index.field_lengths(part_fields(t)).withColumn("avg_len", F.round("avg_len", 6))


@query("t5_keywords", f"""WITH {POSTS}, f AS (SELECT term, count(*) AS df FROM p GROUP BY term), c AS (SELECT count(DISTINCT doc) AS n FROM p),
s AS (SELECT doc, p.term, round(tf * ln(n / df), 6) AS weight FROM p JOIN f USING (term), c)
SELECT doc, term, weight, place FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY weight DESC, term) AS place FROM s) WHERE place <= 6""")
def _(t: Tables):
    return index.index_keywords(index.term_index(t.documents))


@query("t6_hash_vectors", r"""
WITH b AS (SELECT item_id, regexp_replace(lower(text), '\s+', '', 'g') AS s FROM benchmark),
g AS (SELECT item_id, unnest(list_concat([s], CASE WHEN length(s) > 2 THEN list_transform(range(1, length(s)), lambda i: substr(s, i, 2)) ELSE [] END)) AS g FROM b),
h AS (SELECT item_id, unnest([md5(g), md5(g || ' ')]) AS h FROM g),
x AS (SELECT item_id, ('0x' || substr(h, 1, 8))::BIGINT % 256 AS i, CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM h),
y AS (SELECT item_id, i, sum(s)::DOUBLE AS s FROM x GROUP BY ALL HAVING sum(s) <> 0)
SELECT item_id AS doc, i::INT AS i, round(s / sqrt(sum(s * s) OVER (PARTITION BY item_id)), 6) AS x FROM y""")
def _(t: Tables):
    return index.hash_terms(t.benchmark, 256, "item_id").withColumn("x", F.round("x", 6))


@query("t7_unit_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS first FROM embeddings")
def _(t: Tables):
    u = index.unit(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(F.sqrt(index.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"), F.round(u[0], 5).alias("first"))


@query("t8_label_index", """
SELECT 'author' AS kind, array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS key, p_partkey AS work, 'Maker: ' || p_name || '; Unknown' AS line FROM part
UNION ALL SELECT 'date', 'false|' || (1800 + p_size) || '|', p_partkey, 'Date: ' || (1800 + p_size) FROM part""")
def _(t: Tables):
    content = F.concat(F.lit("Title: x\nMaker: "), "p_name", F.lit("; Unknown\nDate: "), (F.col("p_size") + 1800).cast("string"))
    return index.label_index(t.part.select(F.col("p_partkey").alias("work"), content.alias("content")), {"author": ("Maker",), "date": ("Date",)}, UNCERTAIN)


@query("t9_key_index", "SELECT upper(replace(p_brand, '#', '')) AS key, list_sort(list(p_partkey)) AS works FROM part GROUP BY 1")
def _(t: Tables):
    return index.key_index(t.part.withColumnRenamed("p_partkey", "work"), fn.identifier_key(F.regexp_replace("p_brand", "#", " ")))


T10_SQL = """
WITH m AS (SELECT p_partkey AS source_id, CASE WHEN p_partkey % 7 = 0 THEN 'bad' ELSE 'h' || p_partkey END AS source_hash, CASE WHEN p_partkey % 11 = 0 THEN 'colour' ELSE 'name' END AS field,
  CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS text, CASE WHEN p_partkey % 17 = 0 THEN 'draft' ELSE 'reviewed' END AS review_status FROM part)
SELECT source_id, unnest(list_filter([CASE WHEN source_hash = 'bad' THEN 'stale work' END, CASE WHEN field = 'colour' THEN 'unknown field' END, CASE WHEN text = '' THEN 'empty text' END, CASE WHEN review_status = 'draft' THEN 'draft' END], lambda x: x IS NOT NULL)) AS problem FROM m"""


@query("t10_manifest", T10_SQL)
def _(t: Tables):
    from ..operators.cleaning import manifest_problems

    p = F.col("p_partkey")
    works = t.part.select(p.alias("work"), F.concat(F.lit("h"), p.cast("string")).alias("source_hash"), F.concat(F.lit("Name: "), "p_name").alias("content"))
    m = t.part.select(
        p.alias("source_id"), F.when(p % 7 == 0, "bad").otherwise(F.concat(F.lit("h"), p.cast("string"))).alias("source_hash"), F.when(p % 11 == 0, "colour").otherwise("name").alias("field"),
        F.when(p % 13 == 0, "").otherwise(F.col("p_name")).alias("text"), F.array("p_name").alias("quotes"), F.lit("copied").alias("derivation"), F.when(p % 17 == 0, "draft").otherwise("reviewed").alias("review_status"),
    )
    return manifest_problems(m, works, ("name", "brand"))


@query("t11_glossary_fields", "SELECT p_partkey AS work, array_to_string(list_filter([CASE WHEN p_name LIKE '%ring%' THEN '戒指' END, CASE WHEN p_name LIKE 'red%' THEN '红色' END], lambda x: x IS NOT NULL), ' ') AS text FROM part WHERE p_name LIKE '%ring%' OR p_name LIKE 'red%'")
def _(t: Tables):
    from ..operators.cleaning import extend_fields

    words = t.spark.createDataFrame([("ring", "戒指", 1), ("red", "红色", 2)], "phrase string, translation string, place int")
    return extend_fields(t.part.select(F.col("p_partkey").alias("work"), F.col("p_name").alias("text")), words)
