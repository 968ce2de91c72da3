"""Structured Streaming over append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.telemetry import normal, traffic_class

LOG_SCHEMA = "timestamp string, query string, run_context string, result_count long, top_path string, mode string, source_filter string"


def read_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A JSONL query log; lines that are no JSON, and entries without a query, are left out."""
    reader = spark.readStream if stream else spark.read
    rows = reader.schema(LOG_SCHEMA + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter(F.col("_corrupt").isNull() & (F.coalesce("query", F.lit("")) != "")).drop("_corrupt")


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def live_summary(log: DataFrame) -> DataFrame:
    """traffic, entries, zero of a log stream so far (complete mode)."""
    each = log.select(traffic_class(F.col("run_context")).alias("traffic"), (F.col("result_count") == 0).cast("double").alias("zero"), normal(F.col("query")).alias("q"))
    return each.groupBy("traffic").agg(F.count("*").alias("entries"), F.avg("zero").alias("zero"), F.approx_count_distinct("q").alias("queries"))


def hourly(log: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Entries by hour and class, closed once the watermark has passed."""
    timed = log.withColumn("at", F.try_to_timestamp("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", "1 hour"), traffic_class(F.col("run_context")).alias("traffic")).agg(F.count("*").alias("entries"))
