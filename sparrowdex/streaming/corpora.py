"""A corpus of pages in versions: upserts, deletes, whole sources swapped, streams of changes, rollback.

Pages lie in buckets by their path. A change writes the buckets that it touches anew, into a folder of its own, and commits
which folder holds each bucket (see commits). Of writers at the same time each one's change is kept: who comes second
commits its folder on top where the other has touched other buckets, and else writes it again from what is there now. A
stream's batches are committed under the stream's name with their number, so a batch that runs again changes nothing, and
streams with checkpoints of their own, each of which counts from 0, don't take each other's numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import commits
from .commits import State

#: Parts that a bucket's pages are written in.
PARTS = 8


def _read(spark: SparkSession, folder: str, state: State, buckets: Collection[int] | None = None) -> DataFrame | None:
    """Pages of the buckets (all where None) in one scan; None where there are none."""
    paths = [f"{folder}/data/{name}/bucket={b}" for b, name in state["buckets"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(state["columns"]).parquet(*paths) if paths else None


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


def publish(spark: SparkSession, folder: str, fresh: DataFrame | None = None, removed: DataFrame | None = None, sources: Collection[str] | None = None, buckets: int = 64, writer: tuple[str, int] | None = None) -> int | None:
    """Commits fresh pages (path and any other columns) instead of those of their paths; the version's number.

    removed: path of pages that go. sources: sources of which nothing stays but what fresh has of them, whether it has any
    or not. writer: a stream's name and the number of its batch; None is returned where that batch is in already. Of several
    rows of a path the greatest is kept; rows with a null path can't be addressed, and are not taken.
    """
    last = commits.read(spark, folder)
    n = last[1]["n_buckets"] if last else buckets
    bucket = F.pmod(F.xxhash64("path"), F.lit(n)).cast("int")
    rows = paths = None
    touched: set[int] = set()
    if fresh is not None:
        rest = [F.col(f"`{c}`") for c in fresh.columns if c != "path"]
        rows = fresh.filter("path IS NOT NULL").groupBy("path").agg(F.max(F.struct(*rest)).alias("row")).select("path", "row.*").select(*(F.col(f"`{c}`") for c in fresh.columns))
    for d in (rows, removed):
        if d is not None:
            touched |= {r[0] for r in d.filter("path IS NOT NULL").select(bucket.alias("b")).distinct().collect()}  # at most as many numbers as buckets
            paths = d.select("path") if paths is None else paths.unionByName(d.select("path"))
    if sources is not None:
        touched = set(range(n))
    written: dict = {}

    def change(number: int, state: State | None) -> State | None:
        held = dict(state["buckets"]) if state else {}
        writers = dict(state["writers"]) if state else {}
        if writer is not None and writers.get(writer[0], -1) >= writer[1]:
            return None
        if state and state["n_buckets"] != n:
            raise ValueError(f"{folder} was made with {state['n_buckets']} buckets by another writer")
        base = {b: held.get(str(b)) for b in touched}
        if not written or written["base"] != base:
            old = _read(spark, folder, state, touched) if state else None
            if old is not None:
                if paths is not None:
                    old = old.join(paths, "path", "left_anti")
                if sources is not None:
                    old = old.filter(~F.coalesce(F.col("source").isin(list(sources)), F.lit(False)))
            out = rows if old is None else old if rows is None else old.select(*rows.columns).unionByName(rows)
            name = uuid.uuid4().hex
            columns = _ddl(out) if out is not None else None
            if out is not None:
                out.withColumn("__part", F.pmod(F.xxhash64("path", F.lit(1)), F.lit(PARTS))).withColumn("bucket", bucket).repartition("bucket", "__part").drop("__part").write.partitionBy("bucket").parquet(f"{folder}/data/{name}")
            path, fs = commits._path(spark, f"{folder}/data/{name}/bucket=*")
            full = {f.getPath().getName()[7:] for f in fs.globStatus(path) or []}
            written.update(base=base, name=name, full=full, columns=columns)
        left = {b: v for b, v in held.items() if int(b) not in touched}
        if writer is not None:
            writers[writer[0]] = writer[1]
        columns = written["columns"] or (state or {}).get("columns")
        return {"buckets": left | {b: written["name"] for b in written["full"]}, "n_buckets": n, "writers": writers, "columns": columns}

    return commits.update(spark, folder, change)


def swap_source(spark: SparkSession, folder: str, pages: DataFrame, source: str) -> int | None:
    """Puts pages in the place of all of a source's, in one commit: whatever breaks off, the old ones stay or the new ones are there."""
    return publish(spark, folder, pages, sources=[source])


def seed(spark: SparkSession, folder: str, plan: DataFrame, pull: Callable[[str, str, str], DataFrame]) -> int | None:
    """Writes what a seed_plan asks for, each source from pull(source, family, version), and publishes all in one commit.

    plan is small: a row for each pinned source. Where one pull fails nothing is published; rollback takes a seeding back.
    """
    wanted = plan.filter("action = 'seed'").orderBy("source").collect()
    every = None
    for r in wanted:
        own = pull(r.source, r.family, str(r.version)).withColumn("source", F.lit(r.source))
        every = own if every is None else every.unionByName(own)
    return None if every is None else publish(spark, folder, every, sources=[r.source for r in wanted])


def rollback(spark: SparkSession, folder: str, version: int) -> int | None:
    """Commits an earlier version's pages as the latest; streams go on where they are."""
    earlier = commits.read(spark, folder, version)[1]
    return commits.update(spark, folder, lambda _, state: earlier | {"writers": state["writers"]})


def upsert_stream(changes: DataFrame, folder: str, checkpoint: str, buckets: int = 64, stream: str | None = None) -> StreamingQuery:
    """Keeps a corpus up to date from a stream of changed pages; stream is its name, its checkpoint's path where none is given."""

    def merge(batch: DataFrame, number: int) -> None:
        publish(batch.sparkSession, folder, batch, buckets=buckets, writer=(stream or checkpoint, number))

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """The latest version (or an earlier one), if there is any with pages: a reader's plan stays on it."""
    found = commits.read(spark, folder, version)
    return _read(spark, folder, found[1]) if found else None


def changed_since(spark: SparkSession, folder: str, version: int) -> bool:
    """Whether a reader on a version has to open the corpus again."""
    known = commits.versions(spark, folder)
    return bool(known) and known[-1] > version


def vacuum(spark: SparkSession, folder: str, keep: int = 2, pinned: Collection[int] = (), older: float = 86_400.0) -> list[str]:
    """Removes the folders that only older versions have."""
    return commits.vacuum(spark, folder, lambda state: set(state["buckets"].values()), keep, pinned, older)
