"""Tolerant as-of join by a global range partitioning, local scans and a prefix scan over partitions.

Left rows and right rows (one for each key and time, ties settled before by a combining aggregation) are united and range
partitioned by key, time, side and left id, so that no key, however hot, and no single moment has to fit one partition.
Each partition is scanned in its order with the last right row at hand. Left rows before the partition's first right row
of their key stay open, and each partition gives its last right row as a summary. A prefix scan over the summaries (in
blocks of BLOCK, level by level, so that no task sees more than BLOCK of them) gives each partition the last right row
before it, with which its open rows are scanned again. Nothing but the number of partitions goes to the driver.

Left rows without a key or a time, and right rows without one, match nothing; left ones come back unmatched. A null id
is an id like any other. Repeated left rows each get their match, repeated right rows count each in n_tied. Empty sides
give no rows, or unmatched ones. Extra columns don't matter: only those named are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import stored

#: Summaries of so many partitions are scanned together.
BLOCK = 1024


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is read as UTC, whatever the session's zone."""
    c = f"`{name}`"
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"cast(1000000 * cast(cast({c} - timestamp_ntz'1970-01-01 00:00:00' AS interval second) AS decimal(18, 6)) AS bigint)")
    return F.unix_micros(F.col(c).cast("timestamp"))


def _scan(fields: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of key, t, side (0 right, 1 left), id and the right rows' fields, in order, to left rows with their last right row (or open), and a summary (side 2)."""

    def scan(batches):
        from pyspark import TaskContext

        part, last, first = TaskContext.get().partitionId(), None, None
        schema = None
        for batch in batches:
            schema = batch.schema
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if first is None:
                first = rows["key"][0]
            carried = 0 if last is None else 1
            if carried:
                rows = pa.concat_tables([last, rows]).combine_chunks()
            right = rows["side"].to_numpy() == 0
            at = np.maximum.accumulate(np.where(right, np.arange(len(right)), -1))
            left = np.flatnonzero(~right)
            found = at[left]
            of_left, of_right = rows.take(pa.array(left)), rows.take(pa.array(np.maximum(found, 0)))
            seen = pa.array(found >= 0)
            same = pc.and_(seen, pc.equal(of_left["key"], of_right["key"]))
            mine = np.asarray(same.to_numpy(), dtype=bool)
            open_ = ~mine & np.asarray(pc.equal(of_left["key"], first).to_numpy(), dtype=bool)
            mask = pa.array(mine)
            none = [pc.if_else(mask, of_right[c], pa.scalar(None, of_right[c].type)) for c in fields]
            match_t = pc.if_else(mask, of_right["t"], pa.scalar(None, pa.int64()))
            yield from pa.table([of_left["key"], of_left["t"], of_left["id"], pa.array(np.where(open_, 1, 0).astype(np.int32)), pa.array(np.full(len(left), part, np.int32)), match_t, *none], names=["key", "t", "id", "state", "part", "match_t", *fields]).to_batches()
            if at[-1] >= 0:
                last = rows.slice(int(at[-1]), 1).combine_chunks()
        if last is not None:
            yield from pa.table([last["key"], last["t"], pa.nulls(1, last.schema.field("id").type), pa.array([2], pa.int32()), pa.array([part], pa.int32()), last["t"], *(last[c] for c in fields)], names=["key", "t", "id", "state", "part", "match_t", *fields]).to_batches()

    return scan


def carried_in(last: DataFrame) -> DataFrame:
    """last: part and row, a summary of each partition that has one. For every partition up to the largest: part and the row of the nearest partition before it (or null)."""
    spark = last.sparkSession
    n = last.agg(F.max("part")).first()[0]
    if n is None:
        return last.limit(0)
    every = spark.range(n + 2).select(F.col("id").cast("int").alias("part")).join(last.hint("merge"), "part", "left").withColumn("block", F.expr(f"part div {BLOCK}").cast("int"))
    near = every.withColumn("before", F.last("row", ignorenulls=True).over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    if n + 1 < BLOCK:
        return near.select("part", F.col("before").alias("row"))
    ends = last.groupBy(F.expr(f"part div {BLOCK}").cast("int").alias("block")).agg(F.max_by("row", "part").alias("row"))
    above = carried_in(stored(ends.withColumnRenamed("block", "part"), "asof-blocks")).select(F.col("part").alias("block"), F.col("row").alias("above"))
    return near.join(above.hint("merge"), "block", "left").select("part", F.coalesce("before", "above").alias("row"))


def asof_join(left: DataFrame, right: DataFrame, tolerance: int | None, best: list[str], partitions: int | None = None) -> DataFrame:
    """For each row of left (id, key, t) the latest row of right (key, t, and the columns best) with its key, at or before t and at most tolerance earlier.

    Of right rows of one key and time the one with the largest best wins, column by column, null losing. Result: id, key,
    t, match_t, best's columns, n_tied (right rows of the key at match_t; 0 where nothing matches, and the others null).
    """
    if clash := set(best) & {"key", "t", "id", "side", "state", "part", "match_t", "n_tied"}:
        raise ValueError(f"these names are the operator's own: {sorted(clash)}")
    spark = left.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = F.col("key").isNotNull() & F.col("t").isNotNull()
    settled = right.filter(known).groupBy("key", "t").agg(F.max(F.struct(*best)).alias("top"), F.count("*").alias("n_tied"))
    fields = [*best, "n_tied"]
    kinds = dict(right.dtypes) | {"n_tied": "bigint"}
    kind = dict(left.dtypes)["id"]
    rights = settled.select("key", "t", F.lit(0).alias("side"), F.lit(None).cast(kind).alias("id"), *(F.col("top")[c].alias(c) for c in best), "n_tied")
    lefts = left.filter(known).select("key", "t", F.lit(1).alias("side"), "id", *(F.lit(None).cast(kinds[c]).alias(c) for c in fields))
    both = stored(rights.unionByName(lefts), "asof-rows")
    order = ["key", "t", "side", "id"]
    out = StructType.fromDDL(f"key {dict(both.dtypes)['key']}, t bigint, id {kind}, state int, part int, match_t bigint, " + ", ".join(f"`{c}` {kinds[c]}" for c in fields))
    scanned = stored(both.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_scan(fields), out), "asof-scan")
    row = F.struct("key", "match_t", *fields)
    carry = stored(carried_in(scanned.filter("state = 2").select("part", row.alias("row"))), "asof-carry")
    again = scanned.filter("state = 1").select("id", "key", "t", "part").join(carry.hint("merge"), "part", "left")
    hit = F.col("row.key") == F.col("key")
    closed = again.select("id", "key", "t", *(F.when(hit, F.col("row")[c]).alias(c) for c in ("match_t", *fields)))
    absent = left.filter(~known).select("id", "key", "t", F.lit(None).cast("bigint").alias("match_t"), *(F.lit(None).cast(kinds[c]).alias(c) for c in fields))
    done = scanned.filter("state = 0").select("id", "key", "t", "match_t", *fields).unionByName(closed).unionByName(absent)
    near = F.col("match_t").isNotNull() if tolerance is None else F.coalesce(F.col("t") - F.col("match_t") <= tolerance, F.lit(False))
    return done.select("id", "key", "t", *(F.when(near, F.col(c)).alias(c) for c in ("match_t", *best)), F.when(near, F.col("n_tied")).otherwise(0).alias("n_tied"))


HOUR = 3_600_000_000


def _used_time(time: Column, h: Column) -> Column:
    return F.when(h % 2 == 1, time - F.pmod(time, F.lit(6 * HOUR))).otherwise(time)


def clicks_to_orders(clicks: DataFrame, sales: DataFrame, hours: int = 720, partitions: int | None = None) -> DataFrame:
    """For each click_id the client's order at or before it: click_id, client_id, ts_us, sale_id, lag_us, total_cents, n_tied.

    Clicks and sales whose id has an odd crc32 have their times floored to six hours; two of three sales (by crc32) are two
    orders. Of copies of a click_id the earliest counts (no time last, then the smallest client, none last). A total that
    is null or no finite number has no total_cents. A sale without an id is one order.
    """
    one = F.min(F.struct(F.col("ts_us").isNull().alias("a"), "ts_us", F.col("client_id").isNull().alias("b"), "client_id"))
    h = F.crc32(F.col("click_id").cast("string").cast("binary"))
    left = clicks.select("click_id", "client_id", micros(clicks, "ts").alias("ts_us")).groupBy("click_id").agg(one.alias("c"))
    left = left.select(F.col("click_id").alias("id"), F.col("c.client_id").alias("key"), _used_time(F.col("c.ts_us"), h).alias("t"))
    cents = F.floor(100 * F.col("total") + 0.5)
    total_cents = F.when(F.abs("total") < 9e16, cents)  # NaN is above all numbers
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    sold = sales.select("sale_id", F.col("client_id").alias("key"), _used_time(micros(sales, "sold_at"), h).alias("t"), total_cents.alias("total_cents"), h.alias("h"))
    ids = F.when(F.col("h") % 3 != 0, F.array("sale_id", -1 - F.col("sale_id"))).otherwise(F.array("sale_id"))
    right = sold.select("key", "t", "total_cents", F.explode(ids).alias("sale_id"))
    found = asof_join(left, right, hours * HOUR, ["total_cents", "sale_id"], partitions)
    return found.select(F.col("id").alias("click_id"), F.col("key").alias("client_id"), F.col("t").alias("ts_us"), "sale_id", (F.col("t") - F.col("match_t")).alias("lag_us"), "total_cents", "n_tied")
