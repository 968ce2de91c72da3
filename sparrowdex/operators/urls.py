"""URL lists: links of pages and notes, cleaning, one of several locale variants, routes to sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def note_urls(text: Column) -> Column:
    """The URLs in a note, comment lines left out."""
    return F.regexp_extract_all(F.regexp_replace(text, r"(?m)^\s*(#|//).*$", ""), F.lit(r"https?://[^\s)>\"']+"), F.lit(0))


def html_links(html: Column) -> Column:
    """The href values of a page that lead to other web pages, or to paths of its own site."""
    all_ = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<a\s[^>]*href=\"([^\"]*)\""), F.lit(1))
    return F.filter(all_, lambda x: (x != "") & ~x.startswith("#") & ~F.lower(x).rlike("^(mailto|javascript|tel|data):"))


def clean_url(url: Column) -> Column:
    """A URL without fragment, query, and punctuation at its end."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"[.,;:]+$", "")


def first_of_each(urls: DataFrame, key: Column, *order: Column) -> DataFrame:
    """One row of each key, the first in the given order."""
    w = Window.partitionBy("__key").orderBy(*order)
    return urls.withColumn("__key", key).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__key")


def dedupe_urls(urls: DataFrame, url_col: str = "url", order_col: str = "idx") -> DataFrame:
    """idx, url: the cleaned URLs, each where it came first."""
    cleaned = urls.select(F.col(order_col).alias("idx"), clean_url(F.col(url_col)).alias("url")).filter("url <> ''")
    return first_of_each(cleaned, F.col("url"), F.col("idx"))


def dedupe_locales(urls: DataFrame, prefix: str | None = None, limit: int = 0) -> DataFrame:
    """idx, url: of URLs that differ in query and fragment, the first without a locale parameter, or else the first.

    The survivors stand where their group stood first. limit 0: all.
    """
    has = F.col("url").rlike(r"(?i)[?&](hl|lang|locale|language)=").alias("has")
    kept = urls.select("idx", "url", has)
    kept = kept.filter(F.col("url").startswith(prefix)) if prefix else kept
    key = F.regexp_replace("url", r"[?#].*$", "")
    placed = kept.withColumn("at", F.min("idx").over(Window.partitionBy(key)))
    out = first_of_each(placed, key, F.col("has"), F.col("idx")).select(F.col("at").alias("idx"), "url")
    return out.orderBy("idx").limit(limit) if limit else out


def route(urls: DataFrame, routes: DataFrame) -> DataFrame:
    """url, source, rel by the first of routes (idx, host, prefix, source) that fits; none: no row."""
    host, path = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")), F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    u = urls.select("url", host.alias("host"), path.alias("path"))
    fits = u.join(routes, "host").filter(F.col("path").startswith(F.col("prefix")))
    rest = F.expr("trim('/' FROM substring(path, length(prefix) + 1))")
    best = fits.groupBy("url").agg(F.min(F.struct("idx", "source", rest.alias("rest"))).alias("r"))
    return best.select("url", "r.source", F.concat(F.when(F.col("r.rest") == "", "index").otherwise(F.col("r.rest")), F.lit(".md")).alias("rel"))
