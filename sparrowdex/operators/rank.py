"""Re-ranking of merged tiers by integer points, for all queries at once.

Candidates (qid, path) carry the best tier score and what tiers found them; points are added in a fixed order, some of
them relative to the best score of the query so far. All rules are column expressions or windows over a query's few
candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Points.
FLOOR_SURFACE, FLOOR_CONCEPTS = 200, 180
TITLE_TOKEN, INTENDED, PATH_TOKEN, BASENAME_TOKEN = 5, 30, 5, 10
CONCEPT, BASENAME_CONCEPT, BASENAME_MORE, BASENAME_DENSITY = 20, 100, 20, 100
DEPTH_STEP, DEPTH_LEAST, EXACT_TITLE = -2, -16, 100
PROFILE, PROFILE_SUB = 30, 15


@dataclass(frozen=True)
class Boost:
    """Points of a source's pages under a prefix; only of relaxed hits; more where the segment below it is asked for."""

    source: str
    prefix: str
    points: int
    relaxed: bool = False
    topic_points: int = 0


def tier_score(rank: Column) -> Column:
    """Ten times the negated rank, truncated; rounded first, so that sums in another order give the same."""
    return F.round(-rank * 10, 9).cast("int")


def merge(hits: DataFrame) -> DataFrame:
    """One row a candidate from qid, tier, path, source, place, rank."""
    flag = lambda *tiers: F.max(F.col("tier").isin(*tiers)).alias(f"from_{tiers[0]}")
    return hits.groupBy("qid", "path", "source").agg(F.max(tier_score(F.col("rank"))).alias("score"), flag("title"), flag("path"), flag("relaxed", "relaxed_body"), F.min(F.when(F.col("tier") == "relaxed_body", F.col("place"))).alias("relaxed_place"))


def _same_stem(a: Column, b: Column) -> Column:
    """Equal but for a plural ending of either."""
    plural = lambda x, y: (x == F.concat(y, F.lit("s"))) | (x == F.concat(y, F.lit("es"))) | (x == F.regexp_replace(y, "y$", "ies"))
    return (a == b) | plural(a, b) | plural(b, a)


def _concept_in(words: Column, concept: Column) -> Column:
    """Whether a surface's words hold one of a concept's terms: a word, its stem, or part of it, or it of the term."""
    part = lambda w, t: (F.length(w) >= 3) & (F.length(t) >= 3) & (F.contains(w, t) | F.contains(t, w))
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    several = lambda t: F.contains(t, F.lit(" ")) & F.contains(text, F.concat(F.lit(" "), t, F.lit(" ")))
    return F.exists(concept, lambda t: several(t) | F.exists(words, lambda w: _same_stem(w, t) | part(w, t)))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda x: x != "")


def _prefix_points(boosts: tuple[Boost, ...]) -> Column:
    """The points of the prefix rules that a page falls under, and of those whose topic is asked for."""
    points = F.lit(0)
    topic = F.coalesce(F.get(F.split("inner", "/"), F.lit(1)), F.lit(""))
    asked = F.exists("concepts", lambda k: _concept_in(_words(topic), k))
    for b in boosts:
        fits = (F.col("source") == b.source) & F.startswith("inner", F.lit(b.prefix)) & (F.col("from_relaxed") | F.lit(not b.relaxed))
        points = points + F.when(fits, b.points + F.when(asked, b.topic_points).otherwise(0)).otherwise(0)
    return points


def rerank(candidates: DataFrame, plans: DataFrame, corpus: DataFrame, limit: int = 10, boosts: tuple[Boost, ...] = (), profile_points: tuple[int, int] = (PROFILE, PROFILE_SUB)) -> DataFrame:
    """qid, path, source, title, score, tie, place of the best candidates.

    plans: qid, scoring (tokens), synonymed (those of them that have synonyms), concepts (each with its equivalents),
    intended (sources), source_words (keywords of the intended sources), strong (source or null). corpus: path, title;
    in_profile and in_profile_sub if it has them. boosts: what prefixes of a source's paths earn, a short list.
    profile_points: of pages in the profile, and of those in a part of a source that it names.
    """
    profile = [c for c in ("in_profile", "in_profile_sub") if c in corpus.columns]
    c = candidates.join(corpus.select("path", "title", *profile), "path").join(plans, "qid")
    inner = F.regexp_replace("path", "^[^/]*/", "")
    base = F.regexp_replace(F.regexp_replace(F.lower(F.element_at(F.split("path", "/"), -1)), r"\.md$", ""), r"\.mdx$", "")
    c = c.withColumns({"low": F.lower(F.trim("title")), "inner": F.lower(inner), "base": base, "base_words": _words(base)})
    c = c.withColumns({"own": F.array_contains("intended", F.col("source")), "surface_words": F.concat("base_words", _words(F.col("low")), _words(F.col("inner")))})
    telling = F.filter("scoring", lambda t: ~(F.col("own") & F.array_contains("source_words", t)))
    c = c.withColumn("telling", telling)
    count = lambda a, f: F.size(F.filter(a, f))
    c = c.withColumns(
        {
            "in_title": count("telling", lambda t: F.contains(F.col("low"), t)),
            "in_path": count("telling", lambda t: F.contains(F.col("inner"), t)),
            "in_base": count("telling", lambda t: F.contains(F.col("base"), t)),
            "is_base": count("telling", lambda t: ~F.array_contains("synonymed", t) & _same_stem(F.col("base"), t)),
            # Only what the relaxed tiers found is scored by concepts.
            "surface": F.when(F.col("from_relaxed"), count("concepts", lambda k: _concept_in(F.col("surface_words"), k))).otherwise(0),
            "base_concepts": F.when(F.col("from_relaxed"), count("concepts", lambda k: _concept_in(F.col("base_words"), k))).otherwise(0),
            "depth": F.size(F.split("inner", "/")) - 1,
        }
    )
    score = F.when(F.col("from_title") | F.col("from_path"), F.greatest("score", F.lit(FLOOR_SURFACE))).otherwise(F.col("score"))
    score = score + TITLE_TOKEN * F.col("in_title") + F.when(F.col("own"), INTENDED).otherwise(0) + PATH_TOKEN * F.col("in_path") + BASENAME_TOKEN * F.col("is_base") + _prefix_points(boosts)
    named = (F.col("low") != "") & (F.col("low") == F.translate("base", "-_", "  ")) & (F.col("in_title") >= 1) & (F.col("in_base") >= 1)
    both = (F.col("in_title") >= 2) & (F.col("in_base") >= 2)
    c = c.withColumns({"score": score + F.when(named | both, 1).otherwise(0), "tie": F.when(named, 1).otherwise(0)})
    relaxed = F.col("from_relaxed")
    score = F.when(relaxed & (F.col("surface") >= 2), F.greatest("score", F.lit(FLOOR_CONCEPTS))).otherwise(F.col("score"))
    density = F.floor(BASENAME_DENSITY * F.col("base_concepts") / F.greatest(F.size("base_words"), F.lit(1))).cast("int")
    bonus = F.when(F.col("base_concepts") >= 1, BASENAME_CONCEPT + BASENAME_MORE * (F.col("base_concepts") - 1) + density).otherwise(0)
    score = score + F.when(relaxed, CONCEPT * F.col("surface") + bonus).otherwise(0) + F.greatest(DEPTH_STEP * F.col("depth"), F.lit(DEPTH_LEAST))
    if profile:
        score = score + F.when(F.col("in_profile"), profile_points[0]).otherwise(0) + F.when(F.col("in_profile") & F.col("in_profile_sub"), profile_points[1]).otherwise(0)
    c = c.withColumn("score", score)

    of_query = Window.partitionBy("qid")
    best = F.greatest(F.lit(0), F.max("score").over(of_query))
    c = c.withColumn("best", best)
    c = c.withColumn("score", F.col("score") + F.when((F.col("best") > 0) & (F.col("relaxed_place") > 0), F.floor(F.col("best") / F.col("relaxed_place")).cast("int")).otherwise(0))
    c = c.withColumn("best", F.greatest(F.lit(0), F.max("score").over(of_query)))
    exact = F.col("low") == F.array_join("scoring", " ")
    c = c.withColumn("score", F.col("score") + F.when(exact, F.col("best") + EXACT_TITLE).otherwise(0))
    # The best page of the source that is meant comes first.
    meant = F.coalesce(F.col("source") == F.col("strong"), F.lit(False))
    order = [F.desc("score"), F.desc("tie"), F.col("path")]
    c = c.withColumns({"meant": meant, "other": F.max(F.when(~meant, F.col("score"))).over(of_query)})
    c = c.withColumn("nth", F.row_number().over(Window.partitionBy("qid", "meant").orderBy(*order)))
    lifted = F.col("meant") & (F.col("nth") == 1) & (F.col("score") <= F.col("other"))
    c = c.withColumn("score", F.when(lifted, F.col("other") + 1).otherwise(F.col("score")))
    placed = c.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    kept = placed.filter(F.col("place") <= limit) if limit > 0 else placed
    return kept.select("qid", "path", "source", "title", "score", "tie", "place")
