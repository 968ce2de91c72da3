"""Line dedup by distinct-site spread.

A line is boilerplate where it occurs on at least ``min_sites`` distinct sites. HyperLogLog sketches of the sites, one
for each line hash, merge by aggregation; where an estimate lies near the threshold (four standard errors and one site on
either side), the sites are counted exactly. The result equals the exact one unless an estimate is off by more than
that, about once in 16,000 lines whose true spread is just outside; sketches of few sites keep each one's hash, so that at
the default threshold none is. Of a boilerplate line the first occurrence in the corpus (smallest id, then
position) stays, all others go: groups of copies keep one whole copy of their text.

Lines are compared without white space at their ends; blank lines always stay. A null text has no lines and stays null;
a null site is a site of its own. Rows with the same id share their fate; one with a null id counts but keeps its lines. Extra columns are ignored or kept as they are;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, stored

#: Keys that many rows share are dealt to so many tasks.
SALTS = 16


def _lines(df: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    each = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    return each.withColumn("line", F.btrim("line", F.lit(WS))).filter("line <> ''").select("id", "pos", "site", F.unhex(F.md5("line")).alias("key"))


def salted_join(large: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """Inner join of large with small, whose keys are unique, so that one key's rows of large spread over SALTS tasks."""
    left = large.withColumn("salt", F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS)).cast("int"))
    right = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [on, "salt"]).drop("salt")


def boilerplate(lines: DataFrame, min_sites: int = 10, lg_k: int = 12) -> DataFrame:
    """key, first (id and pos), n_sites (exact near the threshold) of each line on min_sites sites or more."""
    sketched = lines.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sites"), F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first"))
    # Fewer occurrences than sites asked for can't reach the threshold, whatever the estimate.
    spread = stored(sketched.filter(F.col("n") >= min_sites).select("key", "first", F.hll_sketch_estimate("sites").alias("estimate")), "line-spread")
    error = 4 * 1.04 / math.sqrt(2**lg_k)
    low, high = math.floor(min_sites * (1 - error)) - 1, math.ceil(min_sites * (1 + error)) + 1
    near = spread.filter(F.col("estimate").between(low, high))
    exact = salted_join(lines, near.select("key"), "key").select("key", "site").distinct().groupBy("key").agg(F.count("*").alias("n_sites")).filter(F.col("n_sites") >= min_sites)
    sure = spread.filter(F.col("estimate") > high).select("key", "first", F.col("estimate").alias("n_sites"))
    return sure.unionByName(near.select("key", "first").join(exact, "key"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, lg_k: int = 12) -> DataFrame:
    """df with its text cleaned, plus n_lines, n_removed and removed (positions of the removed lines, sorted).

    Where df has columns named like these three, they are replaced.
    """
    lines = stored(_lines(df, id_col, text_col, site_col), "lines")
    hit = salted_join(lines, boilerplate(lines, min_sites, lg_k), "key").filter((F.col("first.id") != F.col("id")) | (F.col("first.pos") != F.col("pos")))
    gone = hit.groupBy("id").agg(F.sort_array(F.collect_set("pos")).alias("removed")).select(F.col("id").alias("__gone_id"), F.col("removed").alias("__removed"))
    kept_cols = [c for c in df.columns if c not in ("n_lines", "n_removed", "removed")]
    # The other columns travel in one, so that no name of df can clash.
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.struct(*(F.col(f"`{c}`") for c in kept_cols if c != text_col)).alias("row"))
    joined = rows.join(gone, F.col("id") == F.col("__gone_id"), "left").withColumn("lines", F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("__removed"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return joined.select(
        *((F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept) if c == text_col else F.col("row")[c]).alias(c) for c in kept_cols),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines")).alias("n_lines"),
        F.coalesce(F.size("__removed"), F.lit(0)).alias("n_removed"),
        F.coalesce("__removed", F.array().cast("array<int>")).alias("removed"),
    )
