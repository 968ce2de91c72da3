"""Query logs: summaries by traffic, and test questions mined from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = ("human", "automated", "evaluation")


def normal(q: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(q), r"\s+", " "))


def traffic_class(run_context: Column) -> Column:
    """What kind of caller a context stands for."""
    c = F.lower(F.coalesce(run_context, F.lit("")))
    return F.when(c.rlike("eval|bench|test"), "evaluation").when(c.rlike("agent|bot|batch|cron|ci"), "automated").otherwise("human")


def summary(log: DataFrame) -> DataFrame:
    """traffic, entries, queries (distinct), zero (share without result) of each class; classes without entries count 0.

    log: query, run_context, result_count.
    """
    each = log.filter(F.coalesce("query", F.lit("")) != "").select(traffic_class(F.col("run_context")).alias("traffic"), normal(F.col("query")).alias("q"), "result_count")
    got = each.groupBy("traffic").agg(F.count("*").alias("entries"), F.count_distinct("q").alias("queries"), F.avg((F.col("result_count") == 0).cast("double")).alias("zero"))
    all_ = log.sparkSession.createDataFrame([(c,) for c in CLASSES], "traffic string")
    return all_.join(got, "traffic", "left").na.fill(0, ["entries", "queries", "zero"])


def mine(log: DataFrame, known: DataFrame, since: str | None = None, least_results: int = 1) -> DataFrame:
    """q, top_path, timestamp of human queries with results that are not known yet, the newest of each wording.

    log: query, run_context, result_count, timestamp (RFC 3339 text), top_path. known: q.
    """
    w = Window.partitionBy("key").orderBy(F.desc("timestamp"), "query")
    rows = log.filter((traffic_class(F.col("run_context")) == "human") & (F.col("result_count") >= least_results) & (F.trim("query") != ""))
    rows = rows.filter(F.col("timestamp") >= since) if since else rows
    first = rows.withColumn("key", normal(F.col("query"))).withColumn("n", F.row_number().over(w)).filter("n = 1")
    return first.join(known.select(normal(F.col("q")).alias("key")), "key", "left_anti").select(F.col("query").alias("q"), "top_path", "timestamp")


def newest(log: DataFrame, limit: int = 0) -> DataFrame:
    ordered = log.filter(F.coalesce("query", F.lit("")) != "").orderBy(F.desc("timestamp"), "query")
    return ordered.limit(limit) if limit else ordered


def age_hours(at: Column, now: str) -> Column:
    """Whole hours from a time (ISO 8601) to now; null where it is no time."""
    return F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp(at))) / 3600)


def within_days(at: Column, now: str, days: int) -> Column:
    """Whether a time lies at most so many days before now; false where it is no time."""
    return F.coalesce(age_hours(at, now) <= 24 * days, F.lit(False))
