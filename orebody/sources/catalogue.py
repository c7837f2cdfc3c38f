"""Catalogue records from JSON, growth of a corpus, and blocks of text from pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: Fixed value: what begins a heading in plain text.
HEADING = r"^(第[一二三四五六七八九十百0-9]+[章节部分篇编]|[一二三四五六七八九十]+、|[0-9]+[.、．]\s*[^0-9])"


def works_from_json(raw: Column, keys: dict[str, str], prefix: str) -> Column:
    """struct(id, content, source_hash) of a JSON object: the listed keys without mark-up, as ``label: value`` lines.

    ``keys`` maps a key to its label, in order; empty values are skipped; the hash is that
    of the canonical JSON (sorted keys) of the kept values.
    """
    value = lambda k: strip(F.regexp_replace(F.coalesce(F.get_json_object(raw, f"$.{k}"), F.lit("")), "<[^>]*>", ""))
    lines = [F.when(value(k) != "", F.concat(F.lit(f"{label}: "), value(k))) for k, label in keys.items()]
    canonical = F.to_json(F.struct(*[F.nullif(value(k), F.lit("")).alias(k) for k in sorted(keys)]))
    return F.struct(
        F.concat(F.lit(prefix), F.get_json_object(raw, "$.id")).alias("id"), F.concat_ws("\n", *lines).alias("content"), F.sha2(canonical, 256).alias("source_hash")
    )


def objects_from_nested(rows: DataFrame) -> DataFrame:
    """Museum objects (id, persons, organisations, dates, places): makers, dates and places joined by ``; ``."""
    names = F.concat(F.coalesce("persons", F.array().cast("array<string>")), F.coalesce("organisations", F.array().cast("array<string>")))
    join = lambda c: F.array_join(F.filter(c, lambda x: x.isNotNull() & (x != "")), "; ")
    content = F.concat_ws("\n", F.concat(F.lit("Maker: "), join(names)), F.concat(F.lit("Date: "), join(F.col("dates"))), F.concat(F.lit("Place: "), join(F.col("places"))))
    return rows.select("id", content.alias("content"), F.sha2(content, 256).alias("source_hash"))


def extended(base: DataFrame, candidates: DataFrame, target: int) -> DataFrame:
    """New rows of ``candidates`` (id, image, hash, category, pos) that ``base`` lacks by id, image and hash.

    Each category gives its share of ``target`` in search order; what a category cannot
    give is dealt to the later ones: its quota is ceil(remaining / remaining categories).
    """
    new = candidates.join(base.select("id"), "id", "left_anti").join(base.select("image"), "image", "left_anti").join(base.select("hash"), "hash", "left_anti")
    one = new
    for key in ("id", "image", "hash"):
        one = one.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("category", "pos", "id"))).where("k = 1").drop("k")
    ranked = one.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy("pos", "id")))
    counts = ranked.groupBy("category").agg(F.count("*").alias("n"))
    # The list of categories is a dimension: its fold is one row of an array.
    held = counts.agg(F.array_sort(F.collect_list(F.struct("category", "n"))).alias("c"))
    start = F.struct(F.lit(target).cast("long").alias("left"), F.lit(None).cast("array<struct<category:string,quota:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        done = F.coalesce(F.size(acc["out"]), F.lit(0))
        quota = F.least(x["n"], F.ceil(acc["left"] / (F.size("c") - done)))
        row = F.array(F.struct(x["category"].alias("category"), quota.cast("long").alias("quota")))
        return F.struct((acc["left"] - quota).cast("long").alias("left"), F.when(acc["out"].isNull(), row).otherwise(F.concat(acc["out"], row)).cast("array<struct<category:string,quota:bigint>>").alias("out"))

    quotas = held.select(F.explode(F.aggregate("c", start, step, lambda a: a["out"])).alias("q")).select("q.category", "q.quota")
    return ranked.join(quotas, "category").where("k <= quota").drop("k", "quota")


def html_blocks(pages: DataFrame) -> DataFrame:
    """``page_id``, ``pos``, ``type``, ``level``, ``text``: headings, paragraphs and list items of flat mark-up, in order.

    Scripts, styles and comments are cut first.  A block runs to the next block tag, so
    unclosed paragraphs end where the next begins.  Empty blocks are left out.
    """
    bare = F.regexp_replace("html", r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<title\b.*?</title\s*>", "")
    marked = F.regexp_replace(bare, r"(?i)<(/?)(h[1-6]|p|li|ul|ol|div|article|nav|footer|header|section|table|body|html|head)\b[^>]*>", "\x01$1$2\x02")
    parts = pages.select("page_id", F.posexplode(F.split(marked, "\x01")).alias("pos", "part"))
    tag = F.lower(F.substring_index("part", "\x02", 1))
    raw = F.when(F.contains("part", F.lit("\x02")), F.regexp_replace("part", "(?s)^.*?\x02", "")).otherwise(F.lit(""))
    text = F.regexp_replace(raw, "<[^>]*>", " ")
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(ref), F.lit(char))
    rows = parts.select("page_id", "pos", tag.alias("tag"), strip(F.regexp_replace(text, r"\s+", " ")).alias("text"))
    kind = F.when(F.col("tag").rlike("^h[1-6]$"), "heading").when(F.col("tag") == "li", "list_item").otherwise("paragraph")
    level = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int")).when(F.col("tag") == "li", 1).otherwise(0)
    return rows.where("tag rlike '^(h[1-6]|p|li)$' and text <> ''").select("page_id", "pos", kind.alias("type"), level.alias("level"), "text")


def markdown_blocks(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``block``, ``type``, ``level``, ``text``: headings, list items and paragraphs split at empty lines.

    Lines after a list item belong to it until an empty line.
    """
    lines = docs.select(id_col, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    heading, item, empty = F.col("line").rlike(r"^#{1,6}\s+"), F.col("line").rlike(r"^\s*[-*+]\s+"), F.trim("line") == ""
    kind = F.when(heading, "heading").when(item, "list_item").when(empty, "empty").otherwise("text")
    w = Window.partitionBy(id_col).orderBy("pos")
    rows = lines.withColumn("kind", kind).withColumn("was", F.lag("kind").over(w))
    begins = (F.col("kind") != "text") | F.col("was").isNull() | F.col("was").isin("heading", "empty")
    rows = rows.withColumn("block", F.sum(begins.cast("int")).over(w)).where("kind <> 'empty'")
    clean = F.when(F.col("kind") == "heading", F.trim(F.regexp_replace("line", r"^#{1,6}\s+", ""))).when(F.col("kind") == "list_item", F.regexp_replace("line", r"^\s*[-*+]\s+", "")).otherwise(F.col("line"))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", "^(#+)", 1))).otherwise(0)
    held = rows.groupBy(id_col, "block").agg(F.array_sort(F.collect_list(F.struct("pos", clean.alias("x")))).alias("l"), F.min_by("kind", "pos").alias("kind"), F.max(level).alias("level"))
    return held.select(id_col, "block", F.when(F.col("kind") == "text", "paragraph").otherwise(F.col("kind")).alias("type"), "level", F.array_join(F.transform("l", lambda x: x["x"]), "\n").alias("text"))


def text_blocks(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``pos``, ``type``, ``level``, ``text`` of the lines of plain text; form feeds would begin pages, here ``page`` is 1."""
    lines = docs.select(id_col, F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(id_col, "pos", strip(F.col("line")).alias("text")).where("text <> ''")
    heading = F.col("text").rlike(HEADING) & (F.length("text") <= 60)
    return lines.select(id_col, "pos", F.when(heading, "heading").otherwise("paragraph").alias("type"), F.when(heading, 2).otherwise(0).alias("level"), "text", F.lit(1).alias("page"))


def scan_files(paths: DataFrame, mapping: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Files (path) with a wanted suffix and the department of the first mapped folder (folder, dept) in their path."""
    wanted = paths.where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    parts = wanted.select("path", F.posexplode(F.split("path", "/")).alias("depth", "folder"))
    return parts.join(mapping, "folder").groupBy("path").agg(F.min_by("dept", "depth").alias("dept"))
