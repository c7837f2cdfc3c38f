"""Secret scans with DataFrame functions only.

Base kinds are fixed patterns: ``assign`` (a secret's name, a separator and a value),
``access`` (access key ids) and ``hex`` (long lower-case hex strings).

The method adds ``entropy`` spans.  Candidates are runs of 20 or more characters of the
base64 alphabet with a letter and a digit, in what the base spans leave of the text.  A
window of 20 characters slides over each candidate.  Only the counts of the character
that enters and of the one that leaves change, so two terms of the sum of c * log2(c)
do, and with it the window's Shannon entropy.  Work is linear in the length of the
run.  A candidate whose highest window reaches the threshold of its character class is
a span, unless the allow-list names it; separators at its ends are not judged.

Offsets come from lengths: what ``split`` leaves between the matches of a pattern and
the matches themselves take turns.  Running sums are kept in blocks, so a text with
very many matches does not copy all earlier ones for each.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: Kinds in the order of ties.
KINDS = ("assign", "access", "hex", "entropy")
VALUE_CHARS = 8
WINDOW = 20
#: Bits a character; the first class whose alphabet holds the whole candidate counts.
CLASSES = (("^[0-9a-fA-F]+$", 3.0), ("^[A-Za-z0-9]+$", 3.65), ("", 3.85))
#: What says that a candidate is no secret: placeholders, UUIDs, alphabets and digit rows, where they make
#: up at least one in ``ALLOW_SHARE`` of its characters; in a long run such a word turns up by chance.
ALLOW = (
    r"(?i)example|placeholder|changeme|dummy|your[_-]|xxxx|0123456789|123456789|abcdefgh|ABCDEFGH"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
)
ALLOW_SHARE = 16
#: c * log2(c) for the counts that a window can have, in units of 2**-40: sums of whole numbers do not drift.
_UNIT = 1 << 40
_TERM = [round(c * math.log2(c) * _UNIT) if c else 0 for c in range(WINDOW + 1)]
#: Matches whose offsets are summed together.
BLOCK = 128

SPAN = "array<struct<start:int,kind:int,end:int,body:string>>"


def _before(items: Column, forward: Callable[[Column, Column], Column]) -> Column:
    """For each of ``items`` a struct of what ``forward`` has come to before it (``at``, 0 at first) and itself (``x``)."""

    def in_block(block: Column, at: Column) -> Column:
        none = F.filter(F.transform(block, lambda x: F.struct(at.alias("at"), x.alias("x"))), lambda _: F.lit(False))
        zero = F.struct(at.alias("at"), none.alias("out"))
        step = lambda acc, x: F.struct(forward(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), x.alias("x")))).alias("out"))
        return F.aggregate(block, zero, step, lambda acc: acc["out"])

    def in_blocks(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, block: F.struct(F.aggregate(block, acc["at"], forward).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        begins = F.aggregate(blocks, zero, step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, begins, in_block))

    return let(items, lambda all_: let(_blocks(all_), in_blocks))


def _blocks(items: Column) -> Column:
    """``items`` in arrays of ``BLOCK``; one empty array where there are none."""
    last = F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))


def _spans(text: Column, pattern: str, kind: str, body_group: int = 0) -> Column:
    """All matches of ``pattern`` as (start, kind, end, body), in order; offsets in code points."""
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(body_group)).alias("b"),
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("g"),
    )
    # What follows the last match has no partner: its match is null.
    told = _before(F.filter(found, lambda x: x["m"].isNotNull()), lambda at, x: at + x["g"] + F.length(x["m"]))

    def span(told: Column) -> Column:
        start, x = told["at"] + told["x"]["g"], told["x"]
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(x["m"])).alias("end"), x["b"].alias("body"))

    return F.when(text.rlike(pattern), F.transform(told, span).cast(SPAN)).otherwise(F.array().cast(SPAN))


def _filled(text: Column, spans: Column, fill: Callable[[Column], Column]) -> Column:
    """``text`` with each stretch that ``spans``, sorted by start, cover replaced by ``fill`` of its parts.

    A span has a part from the end of what earlier ones cover; ``fill`` gets that part's
    struct of ``at`` (that end) and ``x`` (the span), which is in the stretch of an earlier one if it starts before ``at``.
    """

    def block(told: Column) -> Column:
        begin, stop = F.get(told, 0)["at"], F.array_max(F.transform(told, lambda t: t["x"]["end"]))

        def pieces(part: Column) -> Column:
            gap = lambda t: F.substring(part, t["at"] - begin + 1, F.greatest(t["x"]["start"] - t["at"], F.lit(0)))
            return F.array_join(F.transform(told, lambda t: F.concat(gap(t), fill(t))), "")

        # The part is cut out once: a substring is found by counting from the front.
        return F.when(F.size(told) > 0, let(F.substring(text, begin + 1, stop - begin), pieces)).otherwise("")

    told = _before(spans, lambda at, x: F.greatest(at, x["end"]))
    rest = F.substring(text, F.array_max(F.transform(spans, lambda x: x["end"])) + 1, F.length(text))
    whole = F.concat(F.array_join(F.transform(let(told, _blocks), block), ""), rest)
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def highest_entropy(run: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits a character, of a window of ``run``; 0 where it is shorter.

    ``window`` is at most ``WINDOW``.  Whatever the length of ``run``, a character costs the same.
    """
    change = F.array(*[F.lit(more - less) for less, more in zip(_TERM, _TERM[1:], strict=False)])
    # The window begins full of a character that no run has.
    zero = F.struct(F.lit("\x00" * window).alias("w"), F.lit(_TERM[window]).alias("sum"), F.lit(None).cast("long").alias("least"))

    def step(acc: Column, come: Column) -> Column:
        kept = F.substring(acc["w"], 2, window - 1)
        at = lambda c: F.get(change, F.lit(window - 1) - F.length(F.replace(kept, c, F.lit(""))))
        now = acc["sum"] + at(come) - at(F.substring(acc["w"], 1, 1))
        return F.struct(F.concat(kept, come).alias("w"), now.alias("sum"), F.when(kept.contains("\x00"), acc["least"]).otherwise(F.least(acc["least"], now)).alias("least"))

    least = F.aggregate(F.split(run, ""), zero, step, lambda acc: acc["least"])
    return F.when(F.length(run) >= window, F.lit(math.log2(window)) - least / float(window * _UNIT)).otherwise(0.0)


def _is_secret(run: Column) -> Column:
    least = F.lit(CLASSES[-1][1])
    for alphabet, bits in reversed(CLASSES[:-1]):
        least = F.when(run.rlike(alphabet), F.lit(bits)).otherwise(least)
    allowed = F.length(run) - F.length(F.regexp_replace(run, ALLOW, ""))
    mixed = run.rlike("[0-9]") & run.rlike("[A-Za-z]") & (allowed * ALLOW_SHARE < F.length(run))
    return F.when(mixed, highest_entropy(run) >= least).otherwise(False)


def _stem(run: Column) -> Column:
    """``run`` without separators at its ends, as long as it stays a candidate."""
    stem = F.regexp_replace(run, "^[+/=_-]+|[+/=_-]+$", "")
    return F.when(F.length(stem) >= WINDOW, stem).otherwise(run)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__base`` and ``__spans``: sorted arrays of (start, kind, end, body).

    ``__base`` holds the fixed kinds, ``__spans`` those and the entropy spans.  Null
    and empty texts have none.  Every row and column is kept as it is; columns named
    ``__base`` or ``__spans`` are replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    assign = F.filter(_spans(text, ASSIGN, "assign", 2), lambda x: F.length(x["body"]) >= VALUE_CHARS)
    base = F.array_sort(F.concat(assign, _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))
    # What base spans cover becomes blank, character by character, so that offsets stay.
    blank = lambda t: F.repeat(F.lit(" "), F.greatest(t["x"]["end"] - F.greatest(t["at"], t["x"]["start"]), F.lit(0)))

    def more(base: Column) -> Column:
        runs = let(_filled(text, base, blank), lambda left: _spans(left, RUN, "entropy"))
        return F.filter(runs, lambda r: let(_stem(r["body"]), _is_secret))

    both = let(base, lambda base: F.struct(base.alias("base"), F.array_sort(F.concat(base, more(base))).alias("spans")))
    found = docs.withColumn("__spans", both)
    return found.withColumn("__base", F.col("__spans.base")).withColumn("__spans", F.col("__spans.spans"))


def _written(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_assign``, ``n_access``, ``n_hex``, ``n_entropy``, ``base``, ``spans`` for each row of ``docs``.

    Spans are written kind:start:end, by start and then kind, joined by commas; the
    end is exclusive.  Repeated rows and null ids stay; an empty table gives none.
    """
    found = scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))

    def count(kind: int) -> Column:
        return F.size(F.filter("__spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    n = [count(kind) for kind in range(len(KINDS))]
    return found.select("id", *n, _written("__base").alias("base"), _written("__spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span of the text, overlapping ones together, replaced by ``mark``.

    Texts without a span, null ones too, stay as they are; no row goes.
    """
    text = F.col(text_col)
    # A span that begins inside what is already gone only makes it longer.
    clean = _filled(text, F.col("__spans"), lambda t: F.when(t["x"]["start"] >= t["at"], mark).otherwise(""))
    return scan(docs, text_col).withColumn(text_col, clean).select(*docs.columns)


#: DuckDB SQL of the registered query; its entropies come from whole windows,
#: and its letters in either case are spelt out, as RE2 folds more than ASCII.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k(kind, name, pat, grp, least) AS (VALUES
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 16),
  (2, 'hex', '[0-9a-f]+', 0, 32)),
rows AS (SELECT row_number() OVER () AS r, * FROM t),
a AS (
  SELECT r, kind, name, least, regexp_extract_all(text, pat, 0) AS m, CASE WHEN grp = 2 THEN regexp_extract_all(text, pat, 2) ELSE regexp_extract_all(text, pat, 0) END AS b, string_split_regex(text, pat) AS g FROM rows, k),
e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM a WHERE len(m) > 0),
base AS (
  SELECT r, kind, name, start, start + length(whole) AS stop FROM (
    SELECT r, kind, name, least, b[i] AS body, m[i] AS whole,
           (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM e)
  WHERE length(body) >= least),
cover AS (SELECT r, list(start || ':' || stop) AS told FROM base GROUP BY r),
masked AS (
  SELECT r, CASE WHEN told IS NULL THEN text ELSE list_reduce(list_prepend(text, told), lambda t, s: substr(t, 1, split_part(s, ':', 1)::INT) || repeat(' ', split_part(s, ':', 2)::INT - split_part(s, ':', 1)::INT) || substr(t, split_part(s, ':', 2)::INT + 1)) END AS text
  FROM rows LEFT JOIN cover USING (r)),
w AS (SELECT r, regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}', 0) AS m, string_split_regex(text, '[A-Za-z0-9+/_=-]{20,}') AS g FROM masked),
runs AS (
  SELECT r, start, start + length(whole) AS stop, CASE WHEN length(stem) >= 20 THEN stem ELSE whole END AS judged FROM (
    SELECT r, m[i] AS whole, regexp_replace(m[i], '^[+/=_-]+|[+/=_-]+$', '', 'g') AS stem,
           (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM w WHERE len(m) > 0))),
extra AS (
  SELECT r, 3 AS kind, 'entropy' AS name, start, stop FROM runs
  WHERE regexp_matches(judged, '[0-9]') AND regexp_matches(judged, '[A-Za-z]')
    AND (length(judged) - length(regexp_replace(judged, '(?i)example|placeholder|changeme|dummy|your[_-]|xxxx|0123456789|123456789|abcdefgh|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$', '', 'g'))) * 16 < length(judged)
    AND list_max(list_transform(range(1, length(judged) - 18), lambda i: list_entropy(string_split(substr(judged, i, 20), '')))) >=
        CASE WHEN regexp_matches(judged, '^[0-9a-fA-F]+$') THEN 3.0 WHEN regexp_matches(judged, '^[A-Za-z0-9]+$') THEN 3.65 ELSE 3.85 END),
every AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
told AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_entropy,
         coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM every GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM rows LEFT JOIN told USING (r)
"""
