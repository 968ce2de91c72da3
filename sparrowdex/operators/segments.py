"""A search index that follows its corpus: postings in segments, upserts and deletes by new segments, versions by commits.

A segment is a folder of pages and postings that is never changed. Each row has the number (seq) of the version that wrote
it. Upserting pages writes a segment of theirs alone, and their paths as gone before that number; deleting writes the paths
only. A row counts where its path is not gone after it. Totals follow by difference: the pages that are replaced are read
from the pages' narrow columns, nothing else is. Where FANOUT segments have about one size they are merged, so that there
are logarithmically many; paths that no older row can have are forgotten then.

Versions are commits (streaming.commits): a reader's index stays on its version, `reopened` moves it to the latest, and a
build that breaks off leaves nothing that anyone reads. Rows with a null path can't be found again and are not indexed; of
several pages of one path in one call one is kept, the greatest row. An empty corpus is an index without pages.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import stored
from ..streaming import commits
from ..streaming.commits import State
from . import bm25
from .manifest import rebuild_or_upsert

#: So many segments of about one size (a power of FANOUT) become one.
FANOUT = 4
FIELDS = ("path", "source", "title", "body")


@dataclass(frozen=True)
class Version:
    """An index as of a version; state as committed."""

    folder: str
    number: int
    index: bm25.Index
    state: State


def _with_digest(pages: DataFrame) -> DataFrame:
    return pages.select(*FIELDS).withColumn("digest", F.sha2(F.concat_ws("\x1f", *(F.coalesce(c, F.lit("\x00")) for c in FIELDS[1:])), 256))


def _digested(corpus: DataFrame) -> DataFrame:
    """One page a path, with the digest of what is indexed. Only pages of repeated paths are shuffled."""
    rows = corpus.filter("path IS NOT NULL")
    again = stored(rows.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1").select("path"), "repeated-paths")
    n = again.count()
    if n == 0:
        return _with_digest(rows)
    again = F.broadcast(again) if n <= bm25.FEW else again
    several = rows.join(again, "path", "left_semi").groupBy("path").agg(F.max(F.struct(*FIELDS[1:])).alias("p")).select("path", "p.*")
    return _with_digest(rows.join(again, "path", "left_anti").select(*FIELDS).unionByName(several.select(*FIELDS)))


def _schemas(spark: SparkSession, stemmed: bool) -> tuple[DataFrame, DataFrame]:
    """Empty pages and postings, for their columns."""
    pages = bm25.analyzed(_with_digest(spark.createDataFrame([], "path string, source string, title string, body string")), stemmed, ("digest",)).withColumn("seq", F.lit(0).cast("long"))
    return pages, bm25.clustered(pages)


def _write(spark: SparkSession, folder: str, pages: DataFrame) -> tuple[str, int, int]:
    """A segment of analysed pages: its name, pages and tokens."""
    name = uuid.uuid4().hex
    pages.write.parquet(f"{folder}/data/{name}/pages")
    back = spark.read.schema(pages.schema).parquet(f"{folder}/data/{name}/pages")
    bm25.clustered(back).write.option("parquet.bloom.filter.enabled#term", "true").partitionBy("bucket").parquet(f"{folder}/data/{name}/postings")
    n, tokens = back.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    return name, n, tokens


def _parts(spark: SparkSession, folder: str, state: State) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Pages and postings of all segments of a state, and path and seq of what is gone."""
    empty_pages, empty_postings = _schemas(spark, state["stemmed"])
    names = [s["name"] for s in state["segments"] if s["pages"]]
    if names:
        pages = spark.read.schema(empty_pages.schema).parquet(*(f"{folder}/data/{n}/pages" for n in names))
        # One scan of all segments: each is read with its buckets as a column.
        each = [spark.read.schema(empty_postings.schema).parquet(f"{folder}/data/{n}/postings") for n in names]
        postings = each[0]
        for p in each[1:]:
            postings = postings.unionByName(p)
    else:
        pages, postings = empty_pages, empty_postings
    gone = None
    if state["gone"]:
        gone = spark.read.schema("path string, seq long").parquet(*(f"{folder}/data/{n}" for n in state["gone"])).groupBy("path").agg(F.max("seq").alias("gone_seq"))
        gone = F.broadcast(gone) if gone.count() <= bm25.FEW else gone
    return pages, postings, gone


def opened(spark: SparkSession, folder: str, version: int | None = None) -> Version | None:
    """The index as of a version, or the latest; None where there is none."""
    found = commits.read(spark, folder, version)
    if found is None:
        return None
    number, state = found
    pages, postings, gone = _parts(spark, folder, state)
    n = state["n_pages"]
    totals = spark.range(1).select(F.lit(float(n)).alias("n_pages"), F.lit(state["n_tokens"] / n if n else None).cast("double").alias("avg_tokens"), F.lit(state["stemmed"]).alias("stemmed"))
    return Version(folder, number, bm25.Index(postings, pages, totals, state["stemmed"], gone, bucketed=True), state)


def reopened(spark: SparkSession, held: Version) -> Version:
    """held, or the latest version where there is a later one."""
    known = commits.versions(spark, held.folder)
    return held if known[-1:] == [held.number] else opened(spark, held.folder)


def build(corpus: DataFrame, folder: str, stemmed: bool = False, note: str | None = None) -> Version:
    """Commits a version that holds the corpus and nothing else. note is kept with it (see refresh)."""
    spark = corpus.sparkSession
    made: list[tuple[str, int, int]] = []
    held: dict[str, int] = {}

    def change(number: int, state: State | None) -> State:
        # Rows written for an earlier number than the one committed count as well: nothing is gone in a new build.
        if not made:
            made.append(_write(spark, folder, bm25.analyzed(_digested(corpus), stemmed, ("digest",)).withColumn("seq", F.lit(number).cast("long"))))
            held["seq"] = number
        name, n, tokens = made[0]
        return {"stemmed": stemmed, "segments": [{"name": name, "pages": n, "least": held["seq"]}], "gone": [], "n_pages": n, "n_tokens": tokens, "note": note}

    return opened(spark, folder, commits.update(spark, folder, change))


def apply(spark: SparkSession, folder: str, fresh: DataFrame | None = None, removed: DataFrame | None = None, note: str | None = None) -> Version:
    """Commits a version with the pages of fresh (path, source, title, body) instead of those of their paths, and without the paths of removed."""
    new = None if fresh is None else stored(_digested(fresh), "fresh-pages")
    paths = [d.select("path") for d in (new, removed) if d is not None]
    touched = stored((paths[0] if len(paths) == 1 else paths[0].unionByName(paths[1])).filter("path IS NOT NULL").distinct(), "touched-paths") if paths else None

    def change(number: int, state: State | None) -> State | None:
        if state is None:
            raise ValueError(f"{folder} holds no index yet")
        if touched is None:
            return None
        # The number is in the rows, so that a conflict means to write them again; they are few.
        pages, _, gone = _parts(spark, folder, state)
        old = bm25.alive(pages.select("path", "seq", "n_tokens").join(touched, "path", "left_semi"), gone).agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        segments, name = list(state["segments"]), uuid.uuid4().hex
        n = tokens = 0
        if new is not None:
            segment, n, tokens = _write(spark, folder, bm25.analyzed(new, state["stemmed"], ("digest",)).withColumn("seq", F.lit(number).cast("long")))
            segments.append({"name": segment, "pages": n, "least": number})
        touched.select("path", F.lit(number).cast("long").alias("seq")).write.parquet(f"{folder}/data/{name}")
        return state | {"segments": segments, "gone": [*state["gone"], name], "n_pages": state["n_pages"] - old[0] + n, "n_tokens": state["n_tokens"] - old[1] + tokens, "note": note}

    commits.update(spark, folder, change)
    merge(spark, folder)
    return opened(spark, folder)


def _tier(pages: int) -> int:
    return int(math.log(max(pages, 1), FANOUT))


def merge(spark: SparkSession, folder: str, everything: bool = False) -> int | None:
    """Merges segments of one size where there are FANOUT, or all; rows that are gone are left out. The new version, if any."""

    def change(number: int, state: State | None) -> State | None:
        if state is None:
            return None
        tiers: dict[int, list[dict]] = {}
        for s in state["segments"]:
            tiers.setdefault(_tier(s["pages"]), []).append(s)
        # What is smaller than a tier that is merged goes with it.
        full = [t for t, held in tiers.items() if len(held) >= FANOUT]
        chosen = state["segments"] if everything else [s for t, held in tiers.items() if full and t <= max(full) for s in held]
        if not chosen or (len(chosen) == 1 and not state["gone"]):
            return None
        some = state | {"segments": chosen}
        pages, _, gone = _parts(spark, folder, some)
        name, n, _ = _write(spark, folder, bm25.alive(pages, gone))
        names = {s["name"] for s in chosen}
        rest = [s for s in state["segments"] if s["name"] not in names]
        kept: list[str] = []
        if rest and gone is not None:
            # Paths are gone for rows before their number only; the merged segment has none of them.
            still = gone.filter(F.col("gone_seq") > min(s["least"] for s in rest)).select("path", F.col("gone_seq").alias("seq"))
            kept.append(uuid.uuid4().hex)
            still.write.parquet(f"{folder}/data/{kept[0]}")
        least = min(s["least"] for s in chosen)
        return state | {"segments": [*rest, {"name": name, "pages": n, "least": least}], "gone": kept}

    return commits.update(spark, folder, change)


def difference(held: Version, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of the corpus that the index lacks or has otherwise, and path of those that it has and the corpus lacks."""
    now = _digested(corpus)
    has = bm25.alive(held.index.pages.select("path", "seq", "digest"), held.index.gone).select("path", "digest")
    # Texts are joined to the paths that changed only.
    changed = stored(now.select("path", "digest").join(has, ["path", "digest"], "left_anti").select("path"), "changed-paths")
    changed = F.broadcast(changed) if changed.count() <= bm25.FEW else changed
    return now.join(changed, "path", "left_semi").select(*FIELDS), has.join(corpus.select("path").filter("path IS NOT NULL"), "path", "left_anti").select("path")


def refresh(corpus: DataFrame, folder: str, stemmed: bool = False, note: str | None = None, share: float = 0.5) -> Version:
    """The index brought up to the corpus: built where there is none or most pages differ, else by upserts and deletes.

    note: what names the corpus' state (see fingerprint); where the latest version has the same one, nothing is read.
    """
    spark = corpus.sparkSession
    held = opened(spark, folder)
    if held is not None and note is not None and held.state["note"] == note and held.state["stemmed"] == stemmed:
        return held
    if held is None or held.state["stemmed"] != stemmed:
        return build(corpus, folder, stemmed, note)
    changed, lost = (stored(d, "index-difference") for d in difference(held, corpus))
    n = changed.count() + lost.count()
    if rebuild_or_upsert(held.index.pages, n, held.state["n_pages"], share) == "rebuild":
        return build(corpus, folder, stemmed, note)
    return apply(spark, folder, changed, lost, note)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names the state of a table's files: their paths, sizes and times. No file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    n, mix = files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return f"{n}:{mix}"


def used(state: State) -> list[str]:
    return [*(s["name"] for s in state["segments"]), *state["gone"]]


def vacuum(spark: SparkSession, folder: str, keep: int = 2, pinned: Collection[int] = (), older: float = 86_400.0) -> list[str]:
    """Removes the folders that only older versions have; those of pinned ones stay."""
    return commits.vacuum(spark, folder, used, keep, pinned, older)


__all__ = ["Version", "apply", "build", "difference", "fingerprint", "merge", "opened", "refresh", "reopened", "vacuum"]
