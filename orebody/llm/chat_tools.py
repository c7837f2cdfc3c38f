"""Chat formatting: link tool calls to their results with DataFrame functions only.

Calls and results are tables; a chat's messages give both (``calls_of``,
``results_of``).  They are hash-joined by conversation and identifier, so a
conversation of any length is spread over all tasks.  A call may name calls that it
comes ``after``.  Calls are in topological order by (turn, level, pos): an earlier turn
comes first, and inside a message ``level`` is the longest chain of its own calls
before a call.  A call after an unknown one, or one that is not before it, says so.

Arguments are checked against the tool's fields and written, with the result, as
canonical JSON: sorted keys, no white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let

CALL = "array<struct<id:string,name:string,arguments:string,after:array<string>>>"
#: JSON types by the leading word of a variant's schema.
TYPES = {"STRING": "string", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "BOOLEAN": "boolean", "ARRAY": "array", "OBJECT": "object", "VOID": "null"}


def _levels(calls: Column) -> Column:
    """For each call of a message the longest chain of its calls before it; null on or behind a cycle.

    The calls that each call names are found once; levels then rise along these edges,
    in as many rounds as the longest chain has calls.
    """

    def of(before: Column) -> Column:
        n = F.size(before)
        zero = F.struct(F.array_repeat(F.lit(0), n).alias("levels"), F.lit(True).alias("moved"))

        def relax(acc: Column, _: Column) -> Column:
            rise = lambda js: F.coalesce(F.array_max(F.transform(js, lambda j: F.get(acc["levels"], j) + 1)), F.lit(0))
            now = lambda levels: F.struct(levels.alias("levels"), (levels != acc["levels"]).alias("moved"))
            return F.when(acc["moved"], let(F.transform(before, rise), now)).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(0), n), zero, relax, lambda acc: F.transform(acc["levels"], lambda x: F.when(x < n, x)))

    def edges(ids: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(ids) - 1)
        return F.transform(calls, lambda c: F.filter(at, lambda j: F.array_contains(c["after"], F.get(ids, j))))

    return let(let(F.transform(calls, lambda c: c["id"]), edges), of)


def calls_of(messages: DataFrame) -> DataFrame:
    """``conv``, ``call_id``, ``turn``, ``pos``, ``level``, ``name``, ``arguments``, ``after`` of assistant messages.

    Their text is JSON with ``tool_calls``: id, name, arguments (an object, or one as a
    string), and after (identifiers).  Other texts, null ones too, hold no call.
    """
    calls = F.from_json("text", f"struct<tool_calls:{CALL}>")["tool_calls"]
    rows = messages.where("role = 'assistant'").select("conv", "turn", F.filter(calls, lambda c: c.isNotNull()).alias("calls")).where(F.size("calls") > 0)
    each = rows.select("conv", "turn", F.posexplode(F.arrays_zip(F.col("calls").alias("c"), _levels(F.col("calls")).alias("level"))).alias("pos", "x"))
    after = F.coalesce(F.col("x.c.after"), F.array().cast("array<string>"))
    return each.select("conv", F.col("x.c.id").alias("call_id"), "turn", "pos", F.col("x.level").alias("level"), F.col("x.c.name").alias("name"), F.col("x.c.arguments").alias("arguments"), after.alias("after"))


def results_of(messages: DataFrame) -> DataFrame:
    """``conv``, ``call_id``, ``turn``, ``content`` of tool messages, whose text is JSON with tool_call_id and content."""
    x = F.from_json("text", "struct<tool_call_id:string,content:string>")
    return messages.where("role = 'tool'").select("conv", x["tool_call_id"].alias("call_id"), "turn", x["content"].alias("content"))


def _type(value: Column) -> Column:
    word = F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)
    return F.element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), word)


def _errors(fields: Column, arguments: Column) -> Column:
    """Problems of ``arguments`` (a map of variants, null where not an object), sorted."""

    def of_field(f: Column) -> Column:
        given = F.element_at(arguments, f["field"])
        kind = _type(given)
        fits = (kind == f["type"]) | ((kind == "integer") & (f["type"] == "number"))
        missing = F.when(f["required"], F.concat(F.lit("missing "), f["field"]))
        return F.when(~F.map_contains_key(arguments, f["field"]), missing).when(~fits, F.concat(F.lit("type "), f["field"]))

    known = F.transform(fields, lambda f: f["field"])
    unknown = F.transform(F.filter(F.map_keys(arguments), lambda k: ~F.array_contains(known, k)), lambda k: F.concat(F.lit("unexpected "), k))
    found = F.array_sort(F.concat(F.array_compact(F.transform(fields, of_field)), unknown))
    return F.when(fields.isNull(), F.array(F.lit("unknown tool"))).when(arguments.isNull(), F.array(F.lit("not an object"))).otherwise(found)


def link(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """One row for each distinct (conversation, identifier) of ``calls`` and ``results``.

    ``tools`` has ``name`` and ``fields``: array of (field, type, required).

    ``status`` is linked, unanswered (no result) or orphan (no call); a result at or before
    its call's turn is linked and ``early``.  Of repeated calls the first by (turn, pos)
    counts, of repeated results the first by (turn, content); ``n_calls`` and ``n_results``
    say how many there were.  Rows without a conversation or identifier are rows of their own and
    link with nothing; all that such a call comes after counts as unknown.  ``order_errors`` counts identifiers in ``after`` that are unknown
    or not before the call, and a cycle inside its message; ``errors`` lists what is wrong with the
    arguments.  ``json`` is null for orphans.  Empty tables give empty results.
    """
    keys = ["conv", "call_id"]
    call = F.struct("turn", "pos", "level", "name", "arguments", "after")
    has = F.col("conv").isNotNull() & F.col("call_id").isNotNull()
    one = F.lit(1).cast("long")
    named = calls.where(has).groupBy(*keys).agg(F.min(call).alias("c"), F.count("*").alias("n_calls"))
    c = named.unionByName(calls.where(~has).select(*keys, call.alias("c"), one.alias("n_calls")))
    r = results.where(has).groupBy(*keys).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    r = r.unionByName(results.where(~has).select(*keys, F.struct("turn", "content").alias("r"), one.alias("n_results")))
    deps = named.select(*keys, F.col("c.turn").alias("turn"), F.col("c.level").alias("level"), F.explode(F.array_distinct("c.after")).alias("dep"))
    known = named.select("conv", F.col("call_id").alias("dep"), F.col("c.turn").alias("dep_turn"), F.col("c.level").alias("dep_level"))
    before = F.coalesce((F.col("dep_turn") < F.col("turn")) | ((F.col("dep_turn") == F.col("turn")) & (F.col("dep_level") < F.col("level"))), F.lit(False))
    order = deps.join(known.hint("shuffle_hash"), ["conv", "dep"], "left").groupBy(*keys).agg(F.sum((~before).cast("long")).alias("late"))
    both = c.join(r, keys, "full_outer").join(order, keys, "left").join(tools.select("name", "fields").withColumnRenamed("name", "tool"), F.col("c.name") == F.col("tool"), "left")
    variant = F.try_parse_json("c.arguments")
    both = both.withColumn("v", variant).withColumn("args", F.try_variant_get("v", "$", "map<string,variant>"))
    cycle = F.when(F.col("c").isNotNull() & F.col("c.level").isNull(), 1).otherwise(0)
    status = F.when(F.col("c").isNull(), "orphan").when(F.col("r").isNull(), "unanswered").otherwise("linked")
    written = F.to_json(
        F.struct(
            F.col("c.after").alias("after"), F.col("v").alias("arguments"), F.col("call_id"), F.col("c.name").alias("name"),
            F.col("r.content").alias("result"), F.col("r.turn").alias("result_turn"), F.col("c.turn").alias("turn"),
        ),
        {"ignoreNullFields": "false"},
    )
    return both.select(
        *keys,
        F.coalesce("c.turn", "r.turn").alias("turn"),
        F.col("c.level").alias("level"),
        F.col("c.pos").alias("pos"),
        status.alias("status"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.coalesce(F.col("r.turn") <= F.col("c.turn"), F.lit(False)).alias("early"),
        (F.coalesce("late", F.when(~has & F.col("c").isNotNull(), F.size(F.array_distinct("c.after"))), F.lit(0)) + cycle).cast("long").alias("order_errors"),
        F.when(F.col("c").isNotNull(), F.array_join(_errors(F.col("fields"), F.col("args")), ",")).alias("errors"),
        F.when(F.col("c").isNotNull(), written).alias("json"),
    )


def _sentences(text: Column) -> Column:
    """The sentences of ``text`` in order: what stands between full stops that white space or the end follows."""
    return F.filter(F.transform(F.split(text, r"\.(?:\s+|\z)"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def turns_as_messages(conversations: DataFrame) -> DataFrame:
    """Plain chats written as messages with tool calls: ``conv``, ``turn``, ``role``, ``text`` (JSON).

    Each sentence of a user turn is a call ``turn.place``: a single word is a ``note``,
    a sentence with a comma a ``list`` of its parts, any other one a ``say``.  A call comes after
    a neighbour in its turn that has fewer words; the first also after the first call of
    the turn before last, where an assistant's turn stands between.  Arguments are left
    as a careless caller writes them: two parts are one string, the last sentence says so
    where nobody asks, more than 40 words are not counted.  The sentences of the
    assistant turn that follows answer the calls of the same places.
    """
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", "role", _sentences(F.col("text")).alias("s"))
    answered = rows.where("role = 'assistant'").select("conv", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("follows")).distinct()
    asks = rows.where("role = 'user'").join(answered.hint("shuffle_hash"), ["conv", "turn"], "left")
    name = lambda turn, place: F.concat_ws(".", turn.cast("string"), place.cast("string"))
    words = lambda s: F.size(F.split(s, " "))

    def call(s: Column, i: Column) -> Column:
        fewer = lambda j: F.when(words(F.get("s", j)) < words(s), name(F.col("turn"), j))
        earlier = F.when((i == 0) & F.col("follows"), name(F.col("turn") - 2, F.lit(0)))
        parts = F.split(s, ", ?")
        counted = F.when(words(s) <= 40, words(s)).alias("words")
        last = F.when(i == F.size("s") - 1, F.lit(True)).alias("last")
        text = s.alias("text")
        told = (
            F.when(F.size(parts) > 2, F.to_json(F.struct(parts.alias("parts"), text, counted)))
            .when(F.size(parts) == 2, F.to_json(F.struct(F.array_join(parts, ", ").alias("parts"), text, counted)))
            .otherwise(F.to_json(F.struct(last, text, counted)))
        )
        tool = F.when(words(s) == 1, "note").when(F.size(parts) > 1, "list").otherwise("say")
        after = F.array_compact(F.array(earlier, fewer(i - 1), fewer(i + 1)))
        return F.struct(name(F.col("turn"), i).alias("id"), tool.alias("name"), told.alias("arguments"), after.alias("after"))

    calls = asks.where(F.size("s") > 0).select(
        "conv", "turn", F.lit("assistant").alias("role"), F.to_json(F.struct(F.transform("s", call).alias("tool_calls"))).alias("text")
    )
    told = rows.where("role = 'assistant'").select("conv", "turn", F.posexplode("s").alias("i", "content"))
    answer = F.to_json(F.struct(name(F.col("turn") - 1, F.col("i")).alias("tool_call_id"), "content"))
    return calls.unionByName(told.select("conv", "turn", F.lit("tool").alias("role"), answer.alias("text")))


def sentence_tools(spark) -> DataFrame:
    """The schemas of the tools that ``turns_as_messages`` calls; nobody knows a ``note``."""
    field = lambda name, kind: f"named_struct('field', '{name}', 'type', '{kind}', 'required', true)"
    plain = f"{field('text', 'string')}, {field('words', 'integer')}"
    return spark.sql(f"SELECT * FROM VALUES ('say', array({plain})), ('list', array({plain}, {field('parts', 'array')})) AS t(name, fields)")


#: DuckDB SQL of the registered query.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\.(?:\s+|\z)'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '') AS s FROM conversations),
u AS (SELECT conv_id, turn, s, len(s) AS n, unnest(range(1, len(s) + 1)) AS i FROM t WHERE role = 'user'),
w AS (SELECT conv_id, turn, n, i, s[i] AS text, len(string_split(s[i], ' ')) AS words, string_split_regex(s[i], ', ?') AS parts FROM u),
c AS (
  SELECT w.*, turn || '.' || (i - 1) AS call_id,
         list_filter([CASE WHEN i = 1 AND EXISTS (SELECT 1 FROM conversations a WHERE a.role = 'assistant' AND a.conv_id = w.conv_id AND a.turn + 1 = w.turn) THEN (turn - 2) || '.0' END,
          CASE WHEN lag(words) OVER near < words THEN turn || '.' || (i - 2) END, CASE WHEN lead(words) OVER near < words THEN turn || '.' || i END], lambda x: x IS NOT NULL) AS after
  FROM w WINDOW near AS (PARTITION BY conv_id, turn ORDER BY i)),
edge AS (
  SELECT a.conv_id, a.turn, a.i, b.i AS j FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn AND abs(a.i - b.i) = 1 AND b.words < a.words),
walk(conv_id, turn, i, long) AS (
  SELECT conv_id, turn, i, 0 FROM w UNION SELECT edge.conv_id, edge.turn, edge.i, walk.long + 1 FROM walk JOIN edge ON edge.conv_id = walk.conv_id AND edge.turn = walk.turn AND edge.j = walk.i),
level AS (SELECT conv_id, turn, i, max(long) AS level FROM walk GROUP BY ALL),
r AS (SELECT conv_id, (turn - 1) || '.' || (i - 1) AS call_id, turn, s[i] AS content FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM t WHERE role = 'assistant')),
late AS (
  SELECT x.conv_id, x.call_id, count(*) AS n FROM (SELECT conv_id, call_id, turn, unnest(after) AS dep FROM c) x
  WHERE split_part(dep, '.', 1)::BIGINT <> turn AND NOT EXISTS (SELECT 1 FROM c d WHERE d.conv_id = x.conv_id AND d.call_id = x.dep) GROUP BY ALL),
told AS (
  SELECT c.*, level,
         CASE WHEN words = 1 THEN 'note' WHEN len(parts) > 1 THEN 'list' ELSE 'say' END AS name,
         '{' || array_to_string(list_filter([
           CASE WHEN len(parts) = 1 AND i = n THEN '"last":true' END,
           CASE WHEN len(parts) > 2 THEN '"parts":' || to_json(parts) WHEN len(parts) = 2 THEN '"parts":' || to_json(array_to_string(parts, ', ')) END,
           '"text":' || to_json(text), CASE WHEN words <= 40 THEN '"words":' || words END], lambda x: x IS NOT NULL), ',') || '}' AS arguments,
         list_filter([CASE WHEN words > 40 THEN 'missing words' END, CASE WHEN len(parts) = 2 THEN 'type parts' END, CASE WHEN len(parts) = 1 AND i = n THEN 'unexpected last' END], lambda x: x IS NOT NULL) AS wrong
  FROM c JOIN level USING (conv_id, turn, i))
SELECT coalesce(told.conv_id, r.conv_id) AS conv_id, coalesce(told.call_id, r.call_id) AS call_id, coalesce(told.turn, r.turn) AS turn,
       level::INT AS level, (i - 1)::INT AS pos,
       CASE WHEN told.turn IS NULL THEN 'orphan' WHEN r.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       (told.turn IS NOT NULL)::INT::BIGINT AS n_calls, (r.turn IS NOT NULL)::INT::BIGINT AS n_results,
       coalesce(r.turn <= told.turn, false) AS early, coalesce(late.n, 0)::BIGINT AS order_errors,
       CASE WHEN name = 'note' THEN 'unknown tool' WHEN told.turn IS NOT NULL THEN array_to_string(wrong, ',') END AS errors,
       CASE WHEN told.turn IS NOT NULL THEN '{"after":' || to_json(after) || ',"arguments":' || arguments || ',"call_id":' || to_json(told.call_id) || ',"name":"' || name || '","result":' ||
         coalesce(to_json(r.content)::VARCHAR, 'null') || ',"result_turn":' || coalesce(r.turn::VARCHAR, 'null') || ',"turn":' || told.turn || '}' END AS json
FROM told FULL JOIN r ON told.conv_id = r.conv_id AND told.call_id = r.call_id
LEFT JOIN late ON late.conv_id = told.conv_id AND late.call_id = told.call_id
"""
