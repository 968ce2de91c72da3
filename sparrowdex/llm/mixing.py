"""Mixing sources to target weights by thresholds on a hash.

Every document has a hash of its id and text. The words of each source are summed by ranges of the hash (STEP bits at a
time), the range in which a source's budget runs out is found from the running sums, and only that range is summed again
by the next bits, until it holds few documents (REFINE). Documents whose hash lies below are taken; nothing is sorted
but the few of the last range. Of these, in the order of the hash, each that still fits is taken, and at last the one
document, if any, that brings the source nearer to its budget. A target above the source's size takes all documents once
(or more) and the rest by the threshold: budgets are nested, so a document within a smaller budget's threshold is also
within a larger one's.

Targets: sources in the order of code points, null last, have the given weights in turn; all together get ``share`` of
all words, no source more than ``repeats`` times its own, and what is cut off goes to the others by weight (the level at
which all of it is placed is found by Newton's steps on exact integers, each of them one sum over the sources).

Nulls: a null text has no words, a null source is a source of its own, a null id is hashed as empty. Documents that are
equal in id and text share their fate. Words of a text that is null or blank are 0, and 0 are taken. An empty table gives
an empty result. Extra columns are ignored, or kept under their own names if asked for in ``keep``; the result's names
(id, size, source_size, target, copies, taken) can't be asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, WS_CLASS, dealt_join, hot_keys, stored

#: Bits of the hash, and how many of them a histogram tells apart.
BITS, STEP = 60, 10
#: A range of the hash with no more documents is settled one by one.
REFINE = 256
#: As many sources are broadcast; beyond, they are joined, with hot ones dealt.
BROADCAST_SOURCES = 10_000
#: Partitions of sources are ranked from the numbers of those before; so many rows of counts go through one task at most.
RANK_PARTS = 64


def n_words(text: Column) -> Column:
    """The number of words `[^\\x20\\x09-\\x0D]+` of text; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WS_CLASS))).cast("long")


def document_hash(doc_id: Column, text: Column, seed: str) -> Column:
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with place: 0 for the first by code point, null last. No task gets all of them."""
    dealt = sources.repartitionByRange(RANK_PARTS, F.col("source").asc_nulls_last())
    parts = stored(dealt.withColumn("part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return parts.join(offsets, "part").withColumn("place", F.col("offset") + F.row_number().over(within) - 1).drop("part", "offset")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), repeats: int = 2) -> DataFrame:
    """sources (source, source_size, ...) with target: share (a fraction) of all words by weight, at most repeats times the size."""
    up, down = share
    if up > repeats * down:
        raise ValueError("the share can't be placed: it is above the repeats")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = stored(_ranked(sources).withColumn("weight", weight.cast("long")), "mix-weights")
    words, weight_sum = (int(x or 0) for x in ranked.agg(F.sum(F.col("source_size").cast("decimal(38,0)")), F.sum("weight")).first())
    # A source is full where left / w_sum * weight > repeats * size, with left words for sources of the weights w_sum.
    left, w_sum, full = up * words, weight_sum, F.lit(False)
    while words:
        full = (F.col("weight").cast("decimal(20,0)") * F.lit(str(left)).cast("decimal(38,0)")) > (F.col("source_size").cast("decimal(20,0)") * F.lit(str(repeats * down * w_sum)).cast("decimal(38,0)"))
        size, w = ranked.filter(full).agg(F.sum(F.col("source_size").cast("decimal(38,0)")), F.sum("weight")).first()
        now = up * words - repeats * down * int(size or 0), weight_sum - int(w or 0)
        if now == (left, w_sum):
            break
        left, w_sum = now
    level = (F.col("weight").cast("double") * F.lit(float(left))) / F.lit(float(down * w_sum or 1))
    return ranked.withColumn("target", F.when(full, (repeats * F.col("source_size")).cast("double")).otherwise(level)).drop("place", "weight")


def _with_source(docs: DataFrame, plan: DataFrame, n_sources: int, hot: DataFrame) -> DataFrame:
    """docs joined with plan by source, null among them."""
    small = plan.withColumn("source", F.struct("source"))
    large = docs.withColumn("source", F.struct("source"))
    joined = large.join(F.broadcast(small), "source") if n_sources <= BROADCAST_SOURCES else dealt_join(large, small, ["source"], hot, ["h"])
    return joined.withColumn("source", F.col("source.source"))


def _settled(units: Column, left: Column) -> Column:
    """Hashes of the units (h, size; sorted) that are taken from a budget of left: each that fits, then the one that brings it nearest."""
    start = F.struct(left.alias("left"), F.array().cast("array<bigint>").alias("taken"))

    def step(a, u):
        fits = u["size"] <= a["left"]
        return F.struct(F.when(fits, a["left"] - u["size"]).otherwise(a["left"]).alias("left"), F.when(fits, F.concat(a["taken"], F.array(u["h"]))).otherwise(a["taken"]).alias("taken"))

    def nearest(a):
        over = F.filter(units, lambda u: ~F.array_contains(a["taken"], u["h"]) & (u["size"] < 2 * a["left"]))
        best = F.array_min(F.transform(over, lambda u: F.struct(F.abs(u["size"] - a["left"]).alias("off"), u["h"].alias("h"))))
        return F.when(best.isNull(), a["taken"]).otherwise(F.concat(a["taken"], F.array(best["h"])))

    return F.aggregate(units, start, step, nearest)


def thresholds(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with base (how often all documents are taken), shift and edge (documents with h >> shift below edge are taken once more) and extra (single hashes).

    docs: source, h, size. plan: source, source_size, target.
    """
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    left = F.col("target") - base * F.col("source_size")
    # edge and left hold for the range that is open: the hashes h with h >> shift = edge.
    at = stored(plan.withColumns({"base": base, "left": left, "edge": F.lit(0).cast("long"), "n": F.col("n_docs")}), "mix-plan")
    n_sources = at.count()
    hot = hot_keys(at.select(F.struct("source").alias("source"), "n_docs"), ["source"], "n_docs")
    shift, done = BITS, []
    while True:
        settled = (F.col("n") <= REFINE) | (F.col("left") <= 0) | F.lit(shift == 0)
        open_ = at.filter(~settled)
        done.append(at.filter(settled).withColumn("shift", F.lit(shift)).drop("n"))
        if open_.isEmpty():
            break
        inside = _with_source(docs, open_.drop("n", "n_docs"), n_sources, hot).filter(F.shiftright("h", shift) == F.col("edge"))
        shift -= STEP
        counted = inside.groupBy("source", F.shiftright("h", shift).alias("range")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("source_size", "target", "base", "left")))
        w = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        below = counted.withColumn("below", F.coalesce(F.sum("size").over(w), F.lit(0)))
        edge = below.filter((F.col("below") <= F.col("left")) & (F.col("below") + F.col("size") > F.col("left")))
        n_docs = at.select(F.struct("source").alias("s"), "n_docs")
        found = edge.withColumns({"left": F.col("left") - F.col("below"), "s": F.struct("source")}).join(n_docs, "s").drop("s")
        at = stored(found.select("source", "source_size", "target", "n_docs", "base", "left", F.col("range").alias("edge"), "n"), "mix-range")
    ends = done[0]
    for d in done[1:]:
        ends = ends.unionByName(d)
    ends = stored(ends, "mix-edges")
    last = _with_source(docs, ends.select("source", "shift", "edge", "left"), n_sources, hot).filter((F.col("left") > 0) & (F.col("size") > 0))
    last = last.filter(F.expr("shiftright(h, shift)") == F.col("edge")).groupBy("source", "h").agg(F.sum("size").alias("size"))
    units = last.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("h", "size"))).alias("units")).select(F.struct("source").alias("s"), "units")
    extra = F.coalesce(_settled(F.col("units"), F.col("left")), F.array().cast("array<bigint>"))
    return ends.withColumn("s", F.struct("source")).join(units, "s", "left").select("source", "source_size", "target", "n_docs", "base", "shift", "edge", extra.alias("extra"))


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), repeats: int = 2, seed: str = "mix", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Per row of df: id, size, source_size, target (of its source), copies (how often the mix takes it), taken (size times copies), and the columns of keep."""
    if clash := set(keep) & {id_col, "size", "source_size", "target", "copies", "taken"}:
        raise ValueError(f"the result has columns of these names: {sorted(clash)}")
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    row = [doc_id.alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), document_hash(doc_id, text, seed).alias("h"), n_words(text).alias("size")]
    docs = stored(df.select(*row), "mix-docs")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    plan = stored(thresholds(docs, targets(sizes, weights, share, repeats)), "mix-thresholds")
    # The texts' columns are read again only where they are asked for.
    rows = df.select(*row, F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept")) if keep else docs
    hot = hot_keys(plan.select(F.struct("source").alias("source"), "n_docs"), ["source"], "n_docs")
    joined = _with_source(rows, plan.drop("n_docs"), plan.count(), hot)
    more = F.expr("shiftright(h, shift) < edge OR shiftright(h, shift) = edge AND array_contains(extra, h)").cast("int")
    copies = F.col("base") + F.when(F.col("base") < repeats, more).otherwise(0)
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *(F.col("kept")[c].alias(c) for c in keep))
