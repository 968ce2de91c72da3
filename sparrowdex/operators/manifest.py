"""Upkeep of keyed tables: manifests by URL, corpora and vectors by path. Every step is a plan over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# So many deletions, or so many and such a share, need consent.
MANY_DELETED, SOME_DELETED, SHARE_DELETED = 50, 5, 0.10


def upsert(base: DataFrame, fresh: DataFrame, key: str | list[str] = "path") -> DataFrame:
    """base with the rows of fresh instead of its own of the same key."""
    return base.join(fresh.select(key), key, "left_anti").select(*base.columns).unionByName(fresh.select(*base.columns))


def delete(base: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def missing(expected: DataFrame, base: DataFrame, key: str = "path") -> DataFrame:
    """Rows of expected that base lacks: what a repair adds."""
    return expected.join(base.select(key), key, "left_anti")


def replace_source(base: DataFrame, fresh: DataFrame, source_col: str = "source", sources: list[str] | None = None) -> DataFrame:
    """base with whole sources replaced by fresh: those that are listed, with or without rows in fresh, or else those of fresh."""
    if sources is None:
        kept = base.join(fresh.select(source_col).distinct(), source_col, "left_anti")
    else:
        kept = base.filter(~F.coalesce(F.col(source_col).isin(sources), F.lit(False)))
        fresh = fresh.filter(F.col(source_col).isin(sources))
    return kept.select(*base.columns).unionByName(fresh.select(*base.columns))


def latest(rows: DataFrame, key: str, *order) -> DataFrame:
    """One row of each key, the first in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def merge_runs(manifests: DataFrame) -> DataFrame:
    """The last run's row of each URL, from rows with a run number."""
    return latest(manifests, "url", F.desc("run"))


def dedupe_paths(manifest: DataFrame) -> DataFrame:
    """Of rows that write one path the newest (of equals the smaller URL); rows without a path all stay."""
    named = manifest.filter(F.coalesce("path", F.lit("")) != "")
    bare = manifest.filter(F.coalesce("path", F.lit("")) == "")
    return latest(named, "path", F.desc("fetched_at"), F.asc("url")).unionByName(bare)


def unchanged(old: DataFrame, new: DataFrame) -> DataFrame:
    """url and unchanged: whether the new body's hash is the old one's."""
    a = old.select("url", F.sha2("body", 256).alias("a"))
    return new.select("url", F.sha2("body", 256).alias("b")).join(a, "url", "left").select("url", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("unchanged"))


def replace_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """url, path, fate, was_there of every URL of either: fresh, kept (skipped for now: the last good row stays), pruned.

    old: url, path. new: url, path, skipped (a passing failure).
    """
    o = old.select("url", F.col("path").alias("old_path"), F.lit(True).alias("was"))
    n = new.select("url", F.col("path").alias("new_path"), "skipped", F.lit(True).alias("here"))
    both = o.join(n, "url", "full_outer")
    fate = F.when(F.col("here").isNull(), "pruned").when(F.col("skipped") & F.col("old_path").isNotNull(), "kept").when(F.col("skipped"), "skipped").otherwise("fresh")
    return both.select("url", F.when(fate == "fresh", F.col("new_path")).otherwise(F.col("old_path")).alias("path"), fate.alias("fate"), F.coalesce("was", F.lit(False)).alias("was_there"))


def deletion_guard(fates: DataFrame) -> DataFrame:
    """n_old (rows that were there before), n_pruned and allowed of a replacement."""
    old = F.count_if("was_there")
    counts = fates.agg(old.alias("n_old"), F.count_if(F.col("fate") == "pruned").alias("n_pruned"))
    stop = (F.col("n_pruned") >= MANY_DELETED) | ((F.col("n_pruned") >= SOME_DELETED) & (F.col("n_pruned") > SHARE_DELETED * F.col("n_old")))
    return counts.withColumn("allowed", ~stop)


def source_index(corpus: DataFrame) -> DataFrame:
    """source, grp, rel, line: the entries of each source's index, grouped by the first two segments below it.

    A line is a row, so that a source of any size is written by its range of tasks; see write_lines().
    """
    parts = F.split("rel", "/")
    grp = F.when(F.size(parts) > 2, F.concat_ws("/", parts[0], parts[1])).when(F.size(parts) == 2, parts[0]).otherwise("")
    line = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("rel"), F.lit(")"))
    return corpus.select("source", grp.alias("grp"), "rel", line.alias("line"))


def top_index(corpus: DataFrame) -> DataFrame:
    """source, n, line: the entries of the index of all sources."""
    line = F.concat(F.lit("- ["), F.col("source"), F.lit("]("), F.col("source"), F.lit("/_INDEX.md) ("), F.col("n").cast("string"), F.lit(")"))
    return corpus.groupBy("source").agg(F.count("*").alias("n")).withColumn("line", line)


def llms_txt(corpus: DataFrame) -> DataFrame:
    """source, section, path, line: the same by first segment (`Docs` without one), linking to the URL where there is one."""
    parts = F.split("rel", "/")
    section = F.when(F.size(parts) > 1, parts[0]).otherwise("Docs")
    link = F.coalesce(F.when(F.col("url") != "", F.col("url")), F.col("path"))
    return corpus.select("source", section.alias("section"), "path", F.concat(F.lit("- ["), F.col("title"), F.lit("]("), link, F.lit(")")).alias("line"))


def write_lines(rows: DataFrame, heading: str, order: str, folder: str) -> None:
    """Index lines as text, a folder a source: each heading's lines below it, in order."""
    first = F.row_number().over(Window.partitionBy("source", heading).orderBy(order)) == 1
    text = F.when(first & (F.col(heading) != ""), F.concat(F.lit("\n## "), F.col(heading), F.lit("\n\n"), F.col("line"))).otherwise(F.col("line"))
    rows.withColumn("text", text).repartitionByRange("source", heading, order).sortWithinPartitions("source", heading, order).select("source", "text").write.partitionBy("source").mode("overwrite").text(folder)


def status(manifest: DataFrame) -> DataFrame:
    """source, n, first and last fetch, n_same (rows that share another's path) of a manifest."""
    return manifest.groupBy("source").agg(F.count("*").alias("n"), F.min("fetched_at").alias("first"), F.max("fetched_at").alias("last"), (F.count("*") - F.count_distinct("path")).alias("n_same"))


def staleness(pages: DataFrame, manifest: DataFrame, now: str, stale_hours: int) -> DataFrame:
    """Per source with pages: n_pages, n_indexable, last, oldest, n_same, missing_fresh, age_hours (0: fresh), place.

    pages: source, rel, body. manifest: source, path, fetched_at (ISO 8601). A source is stale where its last pull is over
    stale_hours old; without any, or with one that is no time, its freshness is missing. place: the order of a report,
    missing ones first, then the oldest.
    """
    from ..sources.corpus import indexable

    n = pages.groupBy("source").agg(F.count("*").alias("n_pages"))
    ok = indexable(pages).groupBy("source").agg(F.count("*").alias("n_indexable"))
    s = n.join(ok, "source", "left").join(status(manifest).select("source", "first", "last", "n_same"), "source", "left")
    seconds = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp("last"))
    missing = F.try_to_timestamp("last").isNull()
    age = F.when(~missing & (seconds > 3600 * stale_hours), F.floor(seconds / 3600)).otherwise(0).cast("long")
    s = s.select("source", "n_pages", F.coalesce("n_indexable", F.lit(0)).alias("n_indexable"), "last", F.col("first").alias("oldest"), F.coalesce("n_same", F.lit(0)).alias("n_same"), missing.alias("missing_fresh"), age.alias("age_hours"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("missing_fresh"), F.desc("age_hours"), "source")))


def index_match(pages: DataFrame, index_pages: DataFrame) -> DataFrame:
    """n_pages, n_indexed, n_missing (indexable but not in the index), n_gone (in the index but not there), matches."""
    both = pages.select("path", F.lit(1).alias("a")).join(index_pages.select("path", F.lit(1).alias("b")), "path", "full_outer")
    out = both.agg(F.count("a").alias("n_pages"), F.count("b").alias("n_indexed"), F.count_if(F.col("b").isNull()).alias("n_missing"), F.count_if(F.col("a").isNull()).alias("n_gone"))
    return out.withColumn("matches", (F.col("n_missing") == 0) & (F.col("n_gone") == 0))


def rebuild_or_upsert(before: DataFrame | None, changed: int, total: int, share: float = 0.5) -> str:
    """`rebuild` where there is no index yet, or most pages changed; else `upsert`."""
    return "rebuild" if before is None or total == 0 or changed > share * total else "upsert"
