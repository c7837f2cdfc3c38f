"""Operators on tables of view vectors, matched points and photo comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import best_works
from .expand import tasks_for
from .index import dot

FEATURE = "array<struct<part:string,relation:string,distinctive:boolean,query_visible:boolean,reference_visible:boolean,query_detail:string,reference_detail:string,query_surface:string,reference_surface:string,same_region:boolean>>"


def best_views(queries: DataFrame, views: DataFrame, k: int = 5) -> DataFrame:
    """The best view of each work by the highest score over query views: ``query``, ``work``, ``view``, ``score``, ``rank``."""
    return best_works(queries, views, k, mean=False)


def coverage(queries: DataFrame, views: DataFrame, k: int = 5) -> DataFrame:
    """Works by their best reference image: the mean over query views of the highest score over the image's views (image = view here)."""
    return best_works(queries, views, k, mean=True).drop("view")


def mutual_patches(similar: DataFrame, least: float = 0.72, margin: float = 0.015) -> DataFrame:
    """Mutual nearest patches of (pair, q, r, s) with a clear second best: ``pair``, ``matches``, ``median``."""

    def best(one: str) -> DataFrame:
        w = Window.partitionBy("pair", one).orderBy(F.desc("s"), "q", "r")
        return similar.withColumn("k", F.row_number().over(w)).withColumn("second", F.lead("s").over(w)).where("k = 1")

    left = best("q").where((F.col("s") >= least) & (F.col("s") - F.coalesce("second", F.lit(-1.0)) >= margin))
    both = left.select("pair", "q", "r", "s").join(best("r").select("pair", "q", "r"), ["pair", "q", "r"])
    return both.groupBy("pair").agg(F.count("*").alias("matches"), F.round(F.expr("percentile_cont(0.5) within group (order by s)"), 9).alias("median"))


def choose_reference(matches: DataFrame) -> DataFrame:
    """Of a hit's references (hit, ref, matches, median, same) the best by matches, median and being the retrieved one."""
    w = Window.partitionBy("hit").orderBy(F.desc("matches"), F.desc("median"), F.desc("same"), "ref")
    return matches.withColumn("k", F.row_number().over(w)).where("k = 1").select("hit", "ref")


def comparison_views(hits: DataFrame, views: DataFrame, works: int = 5, images: int = 2) -> DataFrame:
    """For the first works of hits (query, work, view, rank): the retrieved image, then one of another kind if there is.

    A hit meets its own image and the first ``images`` others of each kind of its work, which hold all that can be chosen.
    """
    top = hits.where(F.col("rank") <= works).select("query", "work", F.col("view").alias("got"), "rank")
    got = views.select(F.col("view").alias("got"), F.col("kind").alias("got_kind"))
    hit = top.join(got, "got")
    own = hit.join(views.select("work", F.col("view").alias("got"), "view", "kind"), ["work", "got"]).select("query", "work", "got", "rank", "got_kind", "view", "kind")
    # One more, as the retrieved one can be among them.
    first = views.withColumn("__k", F.row_number().over(Window.partitionBy("work", "kind").orderBy("view"))).where(F.col("__k") <= images + 1)
    other = hit.join(first.select("work", "view", "kind"), "work").where(~F.col("view").eqNullSafe(F.col("got"))).select(*own.columns)
    rows = own.unionByName(other)
    w = Window.partitionBy("query", "work").orderBy(F.desc(F.col("view") == F.col("got")), F.desc(F.col("kind") != F.col("got_kind")), "view")
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= images).select("query", "work", "view", "k")


def reference_views(works: DataFrame, views: DataFrame, k: int = 2) -> DataFrame:
    """References for text hits: whole views first, no score made up."""
    w = Window.partitionBy("work").orderBy(F.desc(F.col("kind") == "whole"), "view")
    return views.join(works.select("work").distinct(), "work", "left_semi").withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select("work", "view", "k")


def manifest_problems(refs: DataFrame, works: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``ref``, ``problem`` of references (ref, work, source, kind, hash, file_hash)."""
    twice = refs.groupBy("ref").agg(F.count("*").alias("n")).where("n > 1").select("ref", F.lit("duplicate").alias("problem"))
    both = refs.join(works.select("work", "status"), "work", "left")
    checks = (
        ("unknown work", F.coalesce(F.col("status") != "active", F.lit(True))), ("no provenance", F.coalesce(F.trim("source"), F.lit("")) == ""),
        ("bad view", ~F.col("kind").isin(*kinds)), ("changed file", F.col("hash") != F.col("file_hash")),
    )
    return twice.unionByName(both.select("ref", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in checks]))).alias("problem")))


def vector_problem(vec: Column, dim: int, tolerance: float = 1e-4) -> Column:
    """The first of: shape, not finite, not of length one; null where the vector is good."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.size(vec) != dim, "shape").when(bad, "not finite").when(F.abs(F.sqrt(dot(vec, vec)) - 1) > tolerance, "norm")


def normalised_visible(features: Column, known: tuple[str, ...]) -> Column:
    """No match and no difference unless both sides are visible and described; unknown parts are never distinctive."""

    def one(f: Column) -> Column:
        can = f["query_visible"] & f["reference_visible"] & (F.trim(f["query_detail"]) != "") & (F.trim(f["reference_detail"]) != "")
        relation = F.when(f["relation"].isin("visible_match", "visible_conflict") & ~can, F.when(~f["query_visible"], "not_visible").otherwise("cannot_compare")).otherwise(f["relation"])
        part = f["part"].isin(*known)
        return F.struct(F.when(part, f["part"]).otherwise("parts").alias("part"), F.when(relation == "visible_match", "match").when(relation == "visible_conflict", "different").otherwise("not_visible").alias("relation"), (f["distinctive"] & part).alias("distinctive"))

    return F.transform(features, one)


def same_surface(features: Column) -> Column:
    """Matches and conflicts only where both surfaces are known, equal, and show the same region."""

    def one(f: Column) -> Column:
        ok = (f["query_surface"] != "unknown") & (f["query_surface"] == f["reference_surface"]) & f["same_region"]
        kept = F.when(ok | ~f["relation"].isin("visible_match", "visible_conflict"), f["relation"]).otherwise(F.when(f["query_visible"], "cannot_compare").otherwise("not_visible"))
        return f.withField("relation", kept)

    return F.transform(features, one)


def _parts(features: Column, relation: str, distinctive: bool = False) -> Column:
    held = F.filter(features, lambda f: (f["relation"] == relation) & (f["distinctive"] if distinctive else F.lit(True)))
    return F.array_sort(F.array_distinct(F.transform(held, lambda f: f["part"])))


def tiers(candidates: DataFrame) -> DataFrame:
    """Candidates (photo, candidate, identity, features, label, label_required, score) with ``tier`` and ``reason``."""
    matches, different = F.size(_parts(F.col("features"), "match", True)), F.size(_parts(F.col("features"), "different"))
    has, same = F.col("score").isNotNull(), F.col("identity") == "same_work"
    reason = (
        F.when(F.col("label_required") & ~F.col("label"), "lookalike_requires_label").when((different > 0) | (F.col("identity") == "different_work"), "visible_difference")
        .when(same & (F.col("label") | (has & (matches >= 2))), "agreement").when(F.col("identity").isin("same_work", "uncertain") & has & (matches > 0), "partial").otherwise("insufficient")
    )
    rows = candidates.withColumn("reason", reason)
    return rows.select("photo", "candidate", "score", F.when(F.col("reason") == "agreement", "likely").when(F.col("reason") == "partial", "uncertain").otherwise("similar").alias("tier"), "reason")


def decisions(tiered: DataFrame, k: int = 2) -> DataFrame:
    """``photo``, ``state``, ``selected``: up to ``k`` likely or uncertain candidates by score; one alone and likely is a likely match."""
    w = Window.partitionBy("photo").orderBy(F.desc("score"), "candidate")
    kept = tiered.where("tier <> 'similar'").withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)
    held = kept.groupBy("photo").agg(F.array_sort(F.collect_list(F.struct("k", "candidate"))).alias("s"))
    likely = tiered.groupBy("photo").agg(F.bool_or(F.col("tier") == "likely").alias("likely"))
    both = likely.join(held, "photo", "left")
    n = F.coalesce(F.size("s"), F.lit(0))
    state = F.when(F.col("s").isNull(), "no_reliable_match").when(F.col("likely") & (n == 1), "likely_match").otherwise("uncertain")
    return both.select("photo", state.alias("state"), F.coalesce(F.transform("s", lambda x: x["candidate"]), F.array().cast("array<bigint>")).alias("selected"))


def number_clues(photos: DataFrame, index: DataFrame, decided: DataFrame, k: int = 2) -> DataFrame:
    """Works whose identifier was read (photo, key), not selected already, in unresolved photos only; the first ``k``.

    Works of ``index`` (key, works) are sorted, so a photo needs the first ``k`` of a key and as many more as it has selected.
    """
    open_ = decided.where("state <> 'likely_match'").select("photo", "selected")
    some = F.slice("works", F.lit(1), F.lit(k) + F.size("selected"))
    found = photos.join(open_.groupBy("photo").agg(F.array_distinct(F.flatten(F.collect_list("selected"))).alias("selected")), "photo").join(index, "key")
    left = found.select("photo", F.explode(F.array_except(some, "selected")).alias("work")).distinct()
    return left.withColumn("k", F.row_number().over(Window.partitionBy("photo").orderBy("work"))).where(F.col("k") <= k)


def inside_polygons(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Points (point, region, x, y) with ``inside`` by the parity of ray crossings of the region's polygon (region, xs, ys)."""
    edges = polygons.select("region", F.explode(F.sequence(F.lit(1), F.size("xs"))).alias("i"), "xs", "ys")
    nxt = F.when(F.col("i") == F.size("xs"), 1).otherwise(F.col("i") + 1)
    edges = edges.select("region", F.element_at("xs", F.col("i")).alias("ax"), F.element_at("ys", F.col("i")).alias("ay"), F.element_at("xs", nxt).alias("bx"), F.element_at("ys", nxt).alias("by"))
    both = points.join(edges, "region")
    y = F.col("y")
    crosses = ((F.col("ay") > y) != (F.col("by") > y)) & (F.col("x") < F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / F.when(F.col("by") != F.col("ay"), F.col("by") - F.col("ay")))
    return both.groupBy("point").agg((F.sum(F.coalesce(crosses, F.lit(False)).cast("int")) % 2 == 1).alias("inside"))


def rerank_support(hits: DataFrame, inliers: DataFrame, least: int = 12, cells: int = 4) -> DataFrame:
    """Hits (query, work, pos) by inlier count where there are enough over enough cells, the rest keep their order after them."""
    n = inliers.groupBy("query", "work").agg(F.count("*").alias("n"), F.count_distinct("cell").alias("c"))
    both = hits.join(n, ["query", "work"], "left")
    support = F.when((F.col("n") >= least) & (F.col("c") >= cells), F.col("n")).otherwise(0)
    w = Window.partitionBy("query").orderBy(F.desc("support"), "pos")
    return both.withColumn("support", support).select("query", "work", "support", F.row_number().over(w).alias("rank"))


def aliased(candidates: DataFrame) -> DataFrame:
    """Candidates (request, candidate) under names C01, C02, ... that tell nothing of them."""
    w = Window.partitionBy("request").orderBy(F.xxhash64("request", "candidate"), "candidate")
    dealt = candidates.repartition(tasks_for(candidates), "request")
    return dealt.withColumn("alias", F.format_string("C%02d", F.row_number().over(w)))


def restored(answers: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers (request, alias) with their candidates, rejected: unknown or repeated aliases)."""
    tasks = tasks_for(answers)
    n = answers.repartition(tasks, "request", "alias").groupBy("request", "alias").agg(F.count("*").alias("n"))
    both = n.join(aliases.repartition(tasks, "request", "alias"), ["request", "alias"], "left")
    good = both.where("n = 1 and candidate is not null").select("request", "alias", "candidate")
    bad = both.where("n > 1 or candidate is null").select("request", "alias", F.when(F.col("n") > 1, "repeated").otherwise("unknown").alias("problem"))
    return good, bad
