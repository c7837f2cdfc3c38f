"""Sections, chunks and derived views.  Folds run over one document's array, inside one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_of, strip

MIN_CHARS, MAX_CHARS, WRAP = 300, 600, 220


def sections(blocks: DataFrame, id_col: str = "doc_id", depth: int = 6) -> DataFrame:
    """Blocks (pos, type, level, text) with ``section`` and ``path``.

    A heading at level L keeps the latest headings above it, one a level, empty where a
    level was skipped; text before any heading has section 0 and an empty path.
    """
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("type") == "heading"
    out = blocks.withColumn("section", F.sum(heading.cast("int")).over(w)).withColumn("now", F.last(F.when(heading, F.col("level")), ignorenulls=True).over(w))
    at = []
    for k in range(1, depth + 1):
        seen = F.last(F.when(heading & (F.col("level") <= k), F.struct("level", "text")), ignorenulls=True).over(w)
        out = out.withColumn(f"p{k}", F.when(F.coalesce(seen["level"] == k, F.lit(False)), seen["text"]).otherwise(""))
        at.append(F.col(f"p{k}"))
    path = F.slice(F.array(*at), 1, F.coalesce("now", F.lit(0)))
    return out.withColumn("path", path).drop("now", *[f"p{k}" for k in range(1, depth + 1)])


def hard_split(unit: Column, least: int = MIN_CHARS, most: int = MAX_CHARS) -> Column:
    """Pieces of a unit over ``most``: after a sentence end once ``least`` is reached, then equal cuts."""
    cuts = F.regexp_extract_all(unit, F.lit(rf"(?s).{{{least - 1},}}?[。！？；\n]|.+$"), F.lit(0))
    pieces = F.flatten(F.transform(cuts, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))))
    return F.when(F.length(unit) <= most, F.array(unit)).otherwise(pieces)


def pack(pieces: Column, least: int = MIN_CHARS, most: int = MAX_CHARS) -> Column:
    """Greedy packing, joined by newlines: a chunk is closed when the next piece would pass ``most`` and it has ``least``."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"), F.lit(0).alias("len"), F.lit(False).alias("any"))

    def step(acc: Column, p: Column) -> Column:
        close = (acc["len"] + F.length(p) > most) & (acc["len"] >= least)
        joined = F.when(acc["any"], F.concat_ws("\n", acc["buf"], p)).otherwise(p)
        return F.struct(
            F.when(close, F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"]).alias("done"), F.when(close, p).otherwise(joined).alias("buf"),
            F.when(close, F.length(p)).otherwise(acc["len"] + F.length(p)).alias("len"), F.lit(True).alias("any"),
        )

    return F.filter(F.transform(F.aggregate(pieces, start, step, lambda a: F.when(a["any"], F.concat(a["done"], F.array(a["buf"]))).otherwise(a["done"])), lambda x: strip(x)), lambda x: x != "")


def merge_short(chunks: Column, least: int = MIN_CHARS) -> Column:
    """A chunk joins the one before it where either is under ``least``."""

    def step(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        short = (F.size(acc) > 0) & ((F.length(c) < least) | (F.length(last) < least))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(strip(F.concat_ws("\n", last, c))))
        return F.when(short, joined).otherwise(F.concat(acc, F.array(c)))

    return F.aggregate(chunks, F.array().cast("array<string>"), lambda acc, c: F.when(F.size(acc) == 0, F.array(c)).otherwise(step(acc, c)))


def chunk_blocks(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``chunk``, ``section``, ``path``, ``content``, ``chars``, ``hash``: text blocks cut, packed and merged by section.

    The chunk number runs through the document.
    """
    placed = sections(blocks, id_col).where("type <> 'heading'")
    held = placed.groupBy(id_col, "section").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("b"), F.first("path").alias("path"))
    units = F.flatten(F.transform("b", lambda x: hard_split(x["text"])))
    rows = held.select(id_col, "section", "path", F.posexplode(merge_short(pack(units))).alias("k", "content"))
    number = F.row_number().over(Window.partitionBy(id_col).orderBy("section", "k")) - 1
    return rows.select(id_col, number.alias("chunk"), "section", "path", "content", F.length("content").alias("chars"), F.sha2("content", 256).alias("hash"))


def wrap(line: Column, width: int = WRAP) -> Column:
    """Lines of at most ``width`` characters, cut at blanks; longer words are cut where they must be."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    bits = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / width).cast("int")), lambda i: F.substring(w, i * width + 1, F.lit(width)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(acc: Column, w: Column) -> Column:
        fits = F.length(acc["buf"]) + 1 + F.length(w) <= width
        empty = acc["buf"] == ""
        return F.struct(
            F.when(empty | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["buf"]))).alias("done"),
            F.when(empty, w).when(fits, F.concat_ws(" ", acc["buf"], w)).otherwise(w).alias("buf"),
        )

    return F.aggregate(bits, start, step, lambda a: F.when(a["buf"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["buf"]))))


def catalogue_chunks(works: DataFrame, width: int = WRAP) -> DataFrame:
    """``work``, ``chunk`` (from 0), ``line``, ``part``, ``label``, ``piece``, ``content``: content lines wrapped at ``width``, each under the title."""
    lines = works.select("work", "title", F.posexplode(F.split("content", "\n")).alias("line", "x"))
    label = F.when(F.contains("x", F.lit(":")), label_of(F.col("x"))).otherwise("")
    parts = lines.select("work", "title", "line", label.alias("label"), F.posexplode(wrap(F.col("x"), width)).alias("part", "piece"))
    number = F.row_number().over(Window.partitionBy("work").orderBy("line", "part")) - 1
    return parts.select("work", number.alias("chunk"), "line", "part", "label", "piece", F.concat_ws("\n", "title", "piece").alias("content"), "title")


def dense_views(chunks: DataFrame, metadata: tuple[str, ...], body: tuple[str, ...]) -> DataFrame:
    """``work``, ``chunk``, ``view``, ``content``: original, filtered (no metadata lines, their continuations too), normalized (no body label)."""
    meta = F.col("label").isin(*metadata)
    clean = F.when((F.col("part") == 0) & F.col("label").isin(*body), F.ltrim(F.regexp_replace("piece", "^[^:]*:", ""))).otherwise(F.col("piece"))
    original = chunks.select("work", "chunk", F.lit("original").alias("view"), "content")
    kept = chunks.where(~meta)
    filtered = kept.select("work", "chunk", F.lit("filtered").alias("view"), "content")
    normalized = kept.withColumn("c", clean).where(F.trim("c") != "").select("work", "chunk", F.lit("normalized").alias("view"), F.concat_ws("\n", "title", "c").alias("content"))
    return original.unionByName(filtered).unionByName(normalized)


def administrative_view(chunks: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """The original view without the lines of administrative labels."""
    return chunks.where(~F.col("label").isin(*labels)).select("work", "chunk", "content")


def text_budget(chunks: DataFrame, budget: int = 6000, by: str = "doc_id") -> DataFrame:
    """Chunks in order up to ``budget`` characters, the last one cut: ``chunk``, ``content``."""
    w = Window.partitionBy(by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum(F.length("content")).over(w) - F.length("content")
    rows = chunks.withColumn("before", before).where(F.col("before") < budget)
    return rows.select(by, "chunk", F.expr(f"substring(content, 1, int({budget} - before))").alias("content"))


def pack_context(proposals: DataFrame, budget: int) -> DataFrame:
    """Proposals (request, priority, text) under a budget of characters, newlines included.

    Whole texts only, repeated ones once; one that does not fit is omitted and later
    smaller ones may still fit.  ``included`` and ``omitted`` list priorities.
    """
    one = proposals.groupBy("request", "text").agg(F.min("priority").alias("priority"))
    held = one.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("priority", "text"))).alias("p"))
    none = F.array().cast("array<int>")
    start = F.struct(F.lit("").alias("passage"), none.alias("included"), none.alias("omitted"))

    def step(acc: Column, x: Column) -> Column:
        longer = F.when(F.size(acc["included"]) == 0, x["text"]).otherwise(F.concat_ws("\n", acc["passage"], x["text"]))
        fits = F.length(longer) <= budget
        me = F.array(x["priority"].cast("int"))
        return F.struct(F.when(fits, longer).otherwise(acc["passage"]).alias("passage"), F.when(fits, F.concat(acc["included"], me)).otherwise(acc["included"]).alias("included"), F.when(fits, acc["omitted"]).otherwise(F.concat(acc["omitted"], me)).alias("omitted"))

    return held.select("request", F.aggregate("p", start, step).alias("x")).select("request", "x.passage", "x.included", "x.omitted")


def evidence_passage(title: Column, attributes: Column, winners: Column) -> Column:
    """Title, attribute lines and the lanes' winning texts, once each, in order."""
    return F.array_join(F.array_distinct(F.concat(F.array(title), attributes, winners)), "\n")
