"""Facts, sessions and their rules of reading, ageing and forgetting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_sensitive, tokens
from ..session import stored
from .expand import tasks_for
from .index import term_index
from .prefix import running
from .retrieve import one_field
from .topk import top_documents


def user_readable(user: Column, now: Column) -> Column:
    """Owner's active facts (``owner``, ``status``, ``expires_at``) that have not expired."""
    return (F.col("owner") == user) & (F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def org_readable(depts: tuple[str, ...], role: str, now: Column) -> Column:
    """Active, approved facts of ``depts`` whose roles (none: all) allow ``role``, inside their dates."""
    open_ = lambda c, test: F.col(c).isNull() | test
    return (
        (F.col("status") == "active") & F.col("approved") & F.col("dept").isin(*depts)
        & ((F.size("roles") == 0) | F.array_contains("roles", role))
        & open_("effective_from", F.col("effective_from") <= now) & open_("effective_to", F.col("effective_to") >= now) & open_("expires_at", F.col("expires_at") > now)
    )


def in_scope(dept: str, with_global: bool = False) -> Column:
    own = F.col("dept") == dept
    return own | (F.col("scope") == "global") if with_global else own


def sequence_numbers(messages: DataFrame) -> DataFrame:
    """``seq`` from 1 in each session by (ts, id), which tells its messages apart; a long session is numbered by many tasks."""
    return running(messages, ["session"], ["ts", "id"], {"seq": F.lit(1)})


def replay(messages: DataFrame) -> DataFrame:
    """One row a session: its texts in order of ``seq``."""
    held = messages.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("m"))
    return held.select("session", F.transform("m", lambda x: x["text"]).alias("texts"))


def rolling_summary(messages: DataFrame, last: int = 4, chars: int = 240) -> DataFrame:
    """``summary`` at each message: the last ``last`` messages, each cut to ``chars``, ``role: text`` a line."""
    line = F.concat_ws(": ", "role", F.substring("text", 1, chars))
    frame = Window.partitionBy("session").orderBy("seq").rowsBetween(-(last - 1), 0)
    return messages.withColumn("summary", F.array_join(F.collect_list(line).over(frame), "\n"))


def revised_facts(facts: DataFrame, days: int = 180) -> DataFrame:
    """Facts (owner, key, value, ts, id, inferred, consent) as revisions of (owner, key).

    Sensitive ones are rejected, inferred ones without consent are candidates; the newest
    other one is active, earlier ones are superseded by the next; all expire after ``days``.
    """
    kind = F.when(is_sensitive(F.col("key"), F.col("value")), "rejected").when(F.col("inferred") & ~F.col("consent"), "candidate").otherwise("fact")
    marked = facts.withColumn("kind", kind)
    w = Window.partitionBy("owner", "key", "kind").orderBy("ts", "id")
    ranked = marked.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("id").over(w))
    status = F.when(F.col("kind") != "fact", F.col("kind")).when(F.col("next").isNull(), "active").otherwise("superseded")
    is_fact = F.col("kind") == "fact"
    return ranked.select("id", "owner", "key", status.alias("status"), F.when(is_fact, F.col("n")).alias("revision"), F.when(is_fact, F.col("next")).alias("superseded_by"), (F.col("ts") + F.make_dt_interval(F.lit(days))).alias("expires_at"))


def recall(facts: DataFrame, queries: DataFrame, authority: dict[str, float], k: int = 8) -> DataFrame:
    """A user's facts for each of their queries: key named in the query, authority x confidence, last confirmed."""
    weights = F.create_map(*[F.lit(x) for pair in authority.items() for x in pair])
    named = F.contains(F.lower("text"), F.lower("key")).cast("int")
    weight = F.round(F.coalesce(F.element_at(weights, F.col("authority")), F.lit(0.0)) * F.col("confidence"), 6)
    both = queries.join(facts, "owner").withColumns({"named": named, "weight": weight})
    order = Window.partitionBy("query").orderBy(F.desc("named"), F.desc("weight"), F.desc("confirmed_at"), "fact")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "fact", "named", "weight", "rank")


def forget(facts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts (owner, key, id) without the requested ones, and an audit row for each request with what it removed."""
    kept = facts.join(requests, ["owner", "key"], "left_anti")
    gone = requests.join(facts.select("owner", "key", "id"), ["owner", "key"], "left").groupBy("owner", "key").agg(F.count("id").alias("removed"))
    return kept, gone


def valid_sources(facts: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``fact``, ``n_sources``, ``n_valid``: references (fact, dept, version, chunk) whose chunk exists in an active
    document of the same department and, where given, version."""
    n = tasks_for(facts, chunks)
    docs = documents.select("doc", F.col("dept").alias("doc_dept"), F.col("version").alias("doc_version"), "status")
    # Chunks meet documents first: references without a chunk have no document to be dealt by.
    held = chunks.select("chunk", "doc").repartition(n, "doc").join(docs.repartition(n, "doc"), "doc", "left").drop("doc")
    found = facts.repartition(n, "chunk").join(held.repartition(n, "chunk"), "chunk", "left")
    ok = (F.col("status") == "active") & (F.col("dept") == F.col("doc_dept")) & (F.col("version").isNull() | (F.col("version") == F.col("doc_version")))
    marked = found.select("fact", F.coalesce(ok, F.lit(False)).cast("long").alias("ok")).repartition(n, "fact")
    return marked.groupBy("fact").agg(F.count("*").alias("n_sources"), F.sum("ok").alias("n_valid"))


def org_recall(facts: DataFrame, queries: DataFrame, authority: dict[str, float], k: int = 8) -> DataFrame:
    """Organisation facts by token overlap x authority, above 0; the ``k`` best of each query.

    Facts of each authority are scored where they are (``topk.top_documents``).  Queries too many for that, or weights so small
    that six places do not tell one shared token from two, meet facts on shared tokens.
    """
    weights = F.create_map(*[F.lit(x) for pair in authority.items() for x in pair])
    score = F.round(F.col("m") / F.col("n") * F.coalesce(F.element_at(weights, F.col("authority")), F.lit(0.0)), 6)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "fact")
    known = {a: w for a, w in authority.items() if w > 0}
    words = F.array_distinct(tokens(F.col("text")))
    held = stored(queries.select("query", F.size(words).alias("n"), words.alias("words")), "asked")
    q = held.select("query", "n", F.explode("words").alias("term"))
    most, found = held.agg(F.max("n")).first()[0], None
    if known and min(1.0, *known.values()) > 4e-6 * max(most or 0, 1):
        index = one_field(term_index(facts.where(F.col("authority").isin(*known)), "fact", keep=("authority",)), ("authority",))
        found = top_documents(index, q.select("query", "term"), k, {"text": 1.0}, within="authority", presence=True)
    if found is None:
        f = facts.select("fact", "authority", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        shared = q.join(f, "term").groupBy("query", "fact", "n", "authority").agg(F.count("*").alias("m"))
    else:
        best = found.select("query", F.col("doc").alias("fact"), "authority", F.col("score").alias("share"))
        shared = best.join(held.select("query", "n").distinct(), "query").withColumn("m", F.round(F.col("share") * F.col("n")).cast("long"))
    scored = shared.select("query", "fact", score.alias("score")).where("score > 0")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def invalidated(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts (fact, docs) with ``stale``: whether any of their documents is in ``documents``."""
    hit = facts.select("fact", F.explode("docs").alias("doc")).join(documents.select("doc"), "doc", "left_semi").select("fact").distinct().withColumn("stale", F.lit(True))
    return facts.join(hit, "fact", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))


def within_budget(items: DataFrame, budget: int = 6000) -> DataFrame:
    """Items (request, kind_rank, age, size) that stay: dropped from the highest ``kind_rank`` and, inside
    one, from the highest ``age``, until the sizes fit ``budget``."""
    w = Window.partitionBy("request").orderBy("kind_rank", "age", "item").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum("size").over(w)).withColumn("kept", F.col("used") <= budget)


def pruned(table: DataFrame, name: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that have not expired, and (name, removed)."""
    alive = F.col("expires_at").isNull() | (F.col("expires_at") > now)
    return table.where(alive), table.agg(F.sum((~alive).cast("long")).alias("removed")).select(F.lit(name).alias("name"), F.coalesce("removed", F.lit(0)).alias("removed"))


def cascade(tables: dict[str, DataFrame], users: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the rows of ``users`` (user), and (user, name, removed) of all of them."""
    kept = {n: t.join(users, "user", "left_anti") for n, t in tables.items()}
    audit = None
    for n, t in tables.items():
        rows = t.join(users, "user", "left_semi").groupBy("user").agg(F.count("*").alias("removed")).select("user", F.lit(n).alias("name"), "removed")
        audit = rows if audit is None else audit.unionByName(rows)
    return kept, audit


def hot_topics(messages: DataFrame, k: int = 5) -> DataFrame:
    """``dept``, ``day``, ``topic``, ``n``: the first token of two or more characters, else ``other``; top ``k`` a day."""
    topic = F.coalesce(F.get(F.filter(tokens(F.col("text")), lambda w: F.length(w) > 1), F.lit(0)), F.lit("other"))
    n = messages.groupBy("dept", F.to_date("ts").alias("day"), topic.alias("topic")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("dept", "day").orderBy(F.desc("n"), "topic")
    return n.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def profiles(log: DataFrame) -> DataFrame:
    """``user``, ``queries``, ``kinds`` (a map of counts)."""
    n = log.groupBy("user", "kind").agg(F.count("*").alias("n"))
    return n.groupBy("user").agg(F.sum("n").alias("queries"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))


def migrated(legacy: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of legacy maps (owner, facts, sources) that ``existing`` (owner, key) lacks; without a source they are candidates."""
    each = legacy.select("owner", "sources", F.explode("facts").alias("key", "value"))
    status = F.when(F.coalesce(F.size("sources"), F.lit(0)) > 0, "active").otherwise("candidate")
    return each.join(existing, ["owner", "key"], "left_anti").select("owner", "key", "value", status.alias("status"))
