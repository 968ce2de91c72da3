"""N-gram Jaccard join: components of documents whose word-shingle sets are alike, by a size-aware heavy-light join.

Sets are ordered by one global order: shingles by their hash, but those that many documents share last, by how many.
Two sets of Jaccard similarity t or more share c shingles among the first n - ceil(t n) + c of each. A light (small) set
lists its pairs of those with c = 2, a heavy (large) one its single shingles with c = 1; sets near the boundary list
both, so that no pair is lost. The boundary is the size up to which the pairs cost less than scanning the inverted lists,
whose length is measured.

Equal sets become one first. Of each list and size class a few leaders are compared with the rest, which joins the large
groups of near copies without all their pairs. Lists that still hold many pairs of different components are compared with
other leaders, one of each list, as long as that leaves half the pairs or less; then all pairs of a list that lie in
different components so far are found, and compared from the likeliest on as long as that joins many others, so that
every link is either verified or lies inside a component. Comparisons start with a bound from parity bitmaps (bits that
differ are shingles of one side only), a small one within the lists and a large one for each pair; what passes both is
compared in full. Components come from star contraction on written tables.

Where two sets meet in a list that is the first they share, what they have in common lies at its key and behind, so the
place of the key bounds their overlap. Lists and sets that no linked pair can meet in first are left out before any
comparison: texts of one template that differ in a word are told apart by their places alone.

A long list is not compared as one. It is split by size, then twice by the distance of its small bitmaps from that of a
pivot: bits that differ are a metric, so linked sets lie in the same or in neighbouring rings around any pivot. Rings of
one component need no comparison, which is what two large groups of near copies come to; what is left of more than BLOCK
sets is dealt to tasks by pairs of blocks. Joins spread a hot list, leader or set over several tasks, by measured counts.

Which shingles count as shared, the leaders and the pivots affect the cost only, never the result: any order and any
choice give the same components. Shingles are 64-bit hashes of word sequences.

Cases: no ties can arise, as components have one smallest id. A null or blank text has no shingles and is linked with nothing; one with fewer than k words has its whole
sequence as one shingle. Rows with the same id are one node and get its component each; a row with a null id is compared with nothing, and gets the
component of the texts whose set equals its own, or none. Extra columns are ignored; an
empty table gives an empty result; texts are read whole.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import dealt_join, hot_keys, mix, power_table, stored, tidy

#: Bytes of text hashed at once.
CHUNK = 1 << 20
#: A shingle is shared where batches that hold it SHARED_IN_BATCH times or more hold it SHARED times together. At most
#: MAX_SHARED of them, the commonest, are broadcast (16 bytes each); the order of the others is their hash's.
SHARED_IN_BATCH, SHARED, MAX_SHARED = 3, 40, 500_000
#: Subset rows may be at most so many times the rows of the inverted lists.
MAX_SUBSETS = 2
#: Least bits of a parity bitmap, which has at least twice as many bits as the set has shingles.
BITMAP = 1024
#: Words of the small bitmaps that go with the lists whose pairs are all compared.
SKETCH = 8
#: So many of a set's earlier keys tell whether two sets meet in an earlier list.
EARLIER = 4
LEADERS = 3
#: A list of more sets is split by PIVOTS pivots, and dealt by blocks of so many.
BLOCK, PIVOTS = 1024, 2
#: While the lists hold more pairs of different components than PAIRS a member, other leaders are tried, ROUNDS times.
PAIRS, ROUNDS = 8, 6
#: Up to so many documents are told by a broadcast of their ids whose shingles are to be compared in full.
MAX_BROADCAST_IDS = 2_000_000


def _word_hashes(words: list[bytes]) -> np.ndarray:
    values, powers, inverse = power_table(20240229, 0x9E3779B97F4A7C15, CHUNK + 1)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    out = np.empty(len(words), dtype=np.uint64)
    ends = np.cumsum(lengths)
    first = 0
    while first < len(words):
        before = int(ends[first] - lengths[first])
        last = int(np.searchsorted(ends, before + CHUNK, side="right"))
        if last == first:  # one word longer than a chunk
            out[first] = int.from_bytes(hashlib.blake2b(words[first], digest_size=8).digest(), "little")
            first += 1
            continue
        raw = np.frombuffer(b"".join(words[first:last]), dtype=np.uint8)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[raw] * powers[: len(raw)])))
        end, start = ends[first:last] - before, ends[first:last] - lengths[first:last] - before
        out[first:last] = (sums[end] - sums[start]) * inverse[start]
        first = last
    return mix(out + lengths.astype(np.uint64))


def shingles(text: str | None, k: int = 4) -> np.ndarray:
    """The hashes of the distinct k-word shingles of text, sorted (uint64)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    m = min(k, len(words))
    total = np.full(len(h) - m + 1, m, dtype=np.uint64)
    for i in range(m):
        total = total * np.uint64(0xD1342543DE82EF95) + h[i : i + len(total)]
    return np.unique(mix(total))


def least_overlap(n: np.ndarray | int, percent: int):
    """The least overlap of a set of n with one that it is linked with."""
    return (percent * n + 99) // 100


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """Rows with id: n and the set's signature s1, s2. Rows without: a shingle h that a batch holds often, c times."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "s1", "s2", "h", "c"]
        for batch in batches:
            sets = [shingles(t.as_py(), k) for t in batch.column(1)]
            digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), dtype=np.int64).reshape(-1, 2)
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), none, none], names=names)
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            del sets
            every.sort()
            first = np.flatnonzero(np.concatenate((every[:1] == every[:1], every[1:] != every[:-1])))
            c = np.diff(np.append(first, len(every)))
            first, c = first[c >= SHARED_IN_BATCH], c[c >= SHARED_IN_BATCH]
            none = pa.nulls(len(c), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, _signed(every[first]), pa.array(c, pa.int64())], names=names)

    return docs.mapInArrow(tidy(each), "id long, n long, s1 long, s2 long, h long, c long")


def _prefixes(docs: DataFrame, k: int, percent: int, shared: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """id, n, prefix (of n - least overlap + 2 shingles in the global order), bits, and sketch: bits folded to SKETCH words."""
    order = docs.sparkSession.sparkContext.broadcast(shared)
    least = -(-percent // (100 - percent))  # smaller sets are linked with equal ones only

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = order.value
        for batch in batches:
            ids, ns, prefixes, bits, sketches = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(text.as_py(), k)
                n = len(s)
                if n < least:
                    continue
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    rank = np.where(keys[at] == s, counts[at], 0)
                    s = s[np.argsort(rank, kind="stable")]
                size = max(BITMAP, 1 << int(2 * n - 1).bit_length())
                parity = (np.bincount((s >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1).astype(np.uint8)
                ids.append(doc_id)
                ns.append(n)
                prefixes.append(s[: n - least_overlap(n, percent) + 2].view(np.int64))
                bits.append(np.packbits(parity, bitorder="little").view(np.int64))
                sketches.append(np.bitwise_xor.reduce(bits[-1].reshape(-1, SKETCH), axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["id", "n", "prefix", "bits", "sketch"])

    return docs.mapInArrow(tidy(each), "id long, n long, prefix array<long>, bits array<long>, sketch array<long>")


def _long(keys: DataFrame, what: str) -> DataFrame:
    """How long the lists of the keys are: key (null for all lists that are not long together), squares, c."""
    counts = keys.groupBy("key").agg(F.count("*").alias("c"))
    return stored(counts.groupBy(F.when(F.col("c") > common.CHUNK_ROWS, F.col("key")).alias("key")).agg(F.sum(F.col("c") * F.col("c")).alias("squares"), F.sum("c").alias("c")), what)


def _boundary(prefixes: DataFrame, percent: int) -> tuple[int, DataFrame]:
    """The largest size of a light set, by cost; and the hot lists, of single shingles and of pairs: key, chunks.

    A set's pairs cost a row each; scanning costs, for each shingle, its list's length as its members see it, which is
    measured over all lists. Both grow with the size, so the first size whose pairs cost more ends the light ones.
    """
    lengths = _long(prefixes.select(F.explode(F.slice("prefix", F.lit(1), F.size("prefix") - 1)).alias("key")), "list-lengths")
    row = lengths.agg(F.sum("squares"), F.sum("c")).first()
    total = row[1] or 0
    seen = (row[0] or 0) / max(1, total)
    best, spent = 0, 0
    for n, c in prefixes.groupBy("n").agg(F.count("*").alias("c")).orderBy("n").toLocalIterator():
        p = n - least_overlap(n, percent) + 1
        spent += c * (p + 1) * p // 2
        if (p + 1) / 2 > seen or spent > MAX_SUBSETS * total:
            break
        best = n
    logging.getLogger(__name__).info("sets of up to %d shingles are light: a member sees lists of %.1f sets", best, seen)
    long = lengths.filter(F.col("key").isNotNull())
    if best:
        pairs = _long(_postings(prefixes.filter(F.col("n") <= best), best, 100, percent).select("key"), "pair-lengths")
        long = long.unionByName(pairs.filter(F.col("key").isNotNull())).groupBy("key").agg(F.max("c").alias("c"))
    return best, hot_keys(long, ["key"], "c")


def _postings(prefixes: DataFrame, boundary: int, heavy_from: int, percent: int) -> DataFrame:
    """key, id, n, pos (keys' places in an order that all sets share) and reach for every key that a set lists.

    Sets of over heavy_from percent of the boundary list their single shingles. If a key is the first that two sets share,
    they have no shingles in common but its own and what lies behind it; reach is the largest size that another set may
    have then.
    """
    behind = lambda key, left: F.struct(key.alias("key"), (F.floor(left * (100 + percent) / percent) - F.col("n")).alias("reach"))
    pairs = F.flatten(F.transform("prefix", lambda a, i: F.transform(F.slice("prefix", i + 2, F.greatest(F.size("prefix") - i - 1, F.lit(0))), lambda b, j: behind(F.xxhash64(a, b), F.col("n") - i - j))))
    singles = F.transform(F.slice("prefix", F.lit(1), F.size("prefix") - 1), lambda a, i: behind(a, F.col("n") - i))
    none = F.slice(singles, F.lit(1), F.lit(0))
    light = F.when(F.col("n") <= boundary, pairs).otherwise(none)
    heavy = F.when(100 * F.col("n") > heavy_from * boundary, singles).otherwise(none)
    return prefixes.select(F.posexplode(F.concat(light, heavy)).alias("pos", "o"), "id", "n").select("pos", "o.key", "id", "n", "o.reach")


#: Of two sets that may be linked, if this key is the first that they share, the smaller one reaches at least its own size.
STRONG = "reach >= n"


def _lists(postings: DataFrame, hot: DataFrame, parts: int) -> DataFrame:
    """Rows of lists that may hold the first shared key of a linked pair, with chunk, and chunks where the list is hot.

    A pair needs a set that reaches its own size, the smaller one; lists without one go, and so do the sets that no such
    set of their list reaches.
    """
    chunk = F.pmod(F.xxhash64("id"), F.coalesce("chunks", F.lit(1))).cast("int")
    dealt = postings.join(F.broadcast(hot), "key", "left").withColumn("chunk", chunk).repartition(parts, "key", "chunk")
    strong = F.expr(STRONG)
    facts = {"n_rows": F.count("*"), "far": F.max(F.when(strong, F.col("reach"))), "low": F.min(F.when(strong, F.col("n"))), "of": F.max("chunks")}
    each = dealt.groupBy("key", "chunk").agg(*(c.alias(n) for n, c in facts.items()))
    cold = each.filter("of IS NULL AND n_rows > 1 AND far IS NOT NULL").select("key", "chunk", "far", "low")
    # Hot lists have their facts from all their chunks; there are at most MAX_HOT such lists.
    whole = each.filter("of IS NOT NULL").groupBy("key").agg(F.max("far").alias("far"), F.min("low").alias("low"), F.max("of").alias("of")).filter("far IS NOT NULL")
    known = cold.unionByName(whole.select("key", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("chunk"), "far", "low"))
    return dealt.join(known, ["key", "chunk"]).filter(strong | ((F.col("far") >= F.col("n")) & (F.col("low") <= F.col("reach")))).drop("far", "low")


def _ends(pairs: DataFrame) -> DataFrame:
    """id and n, in how many of the pairs it is."""
    return stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n")), "pair-counts")


def _of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among the distinct ids of a stored table."""
    ids = ids.select("id")
    return rows.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, "id", "left_semi")


def _verified(pairs: DataFrame, prefixes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the distinct pairs (a < b), those that are linked."""
    ends = _ends(pairs)
    facts = _of(prefixes.select("id", "n", "bits"), ends)
    side = {x: facts.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab"}
    # The larger bitmap folds onto the smaller; bits that differ are shingles of one side only, at least.
    larger, smaller = (F.when((F.size("bitsa") >= F.size("bitsb")) == way, F.col("bitsa")).otherwise(F.col("bitsb")) for way in (True, False))
    hot = hot_keys(ends, ["id"], "n")  # a leader has many pairs

    def with_sides(pairs: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
        first = dealt_join(pairs, one, ["a"], hot.withColumnRenamed("id", "a"), ["b"])
        return dealt_join(first, two, ["b"], hot.withColumnRenamed("id", "b"), ["a"])

    both = with_sides(pairs, side["a"], side["b"]).select("a", "b", "na", "nb", larger.alias("x"), smaller.alias("y"))
    folded = lambda i: F.aggregate(F.sequence(i, F.size("x") - 1, F.size("y")), F.lit(0).cast("long"), lambda s, k: s.bitwiseXOR(F.get("x", k)))
    apart = F.aggregate(F.transform("y", lambda v, i: F.bit_count(v.bitwiseXOR(folded(i)))), F.lit(0), lambda s, v: s + v)
    near = both.filter(apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
    near = stored(near.select("a", "b").distinct(), "near-pairs")
    ids = stored(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "compared-ids")
    wanted = _of(docs, ids).dropDuplicates(["id"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), k).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    sets = stored(wanted.mapInArrow(tidy(each), "id long, s array<long>"), "compared-sets")
    both = with_sides(near, sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb")))
    overlap = F.size(F.array_intersect("sa", "sb"))
    return stored(both.withColumn("o", overlap).filter(100 * F.col("o") >= percent * (F.size("sa") + F.size("sb") - F.col("o"))).select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """id and component, the smallest id reachable, of every id that has a link (a, b)."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        # Large star: each node hands the smallest of its neighbours and itself to its larger neighbours.
        ways = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ways.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: each node hands its smallest neighbour to the others that are not larger than it, and to itself.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = stored(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        before = now


def _class(n: Column | str, percent: int) -> Column:
    """Sets that may be linked have the same size class or neighbouring ones."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(100 / percent))).cast("int")


def _stars(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of the members of a list and size class with its leaders."""
    classed = lists.withColumn("class", _class("n", percent))

    def led(part: DataFrame, keys: list[str]) -> DataFrame:
        leaders = part.groupBy("key", "class").agg(F.max("chunks").alias("chunks"), *(F.min(F.struct(F.xxhash64("id", F.lit(i)), "id", "n")).alias(f"l{i}") for i in range(LEADERS)))
        if "chunk" in keys:
            leaders = leaders.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        return part.join(leaders.drop("chunks"), keys).select("id", "n", F.explode(F.array(*(f"l{i}" for i in range(LEADERS)))).alias("l"))

    pairs = led(classed.filter("chunks IS NULL"), ["key", "class"]).unionByName(led(classed.filter("chunks IS NOT NULL"), ["key", "class", "chunk"]))
    alike = 100 * F.least("n", "l.n") >= percent * F.greatest("n", "l.n")
    return pairs.filter(F.col("l.id") != F.col("id")).filter(alike).select(F.least("id", "l.id").alias("a"), F.greatest("id", "l.id").alias("b")).distinct()


def _open_lists(lists: DataFrame, joined: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The members of the lists of several components, with component, m (the list's length), sketch and earlier keys."""
    placed = lists.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m"), F.max("chunks").alias("chunks")).filter("x <> y")
    each = mixed.select("key", "m", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"))
    several = placed.join(each, ["key", "chunk"]).select("key", "pos", "id", "n", "reach", "component", "m")
    sketches = prefixes.select("id", *(F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(SKETCH)))
    # Sets that share one of the keys before this one are paired there already.
    before = Window.partitionBy("id").orderBy("pos")
    return stored(several.join(sketches, "id").withColumns({f"p{i}": F.lag("key", i).over(before) for i in range(1, EARLIER + 1)}).drop("pos"), "open-lists")


def _alike(end: str, percent: int) -> Column:
    """Whether two sets may be linked by their sizes and sketches."""
    return (100 * F.least("n", f"n{end}") >= percent * F.greatest("n", f"n{end}")) & (_bits_apart(end) * (100 + percent) <= (F.col("n") + F.col(f"n{end}")) * (100 - percent))


def _bits_apart(end: str) -> Column:
    return sum(F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"s{i}{end}"))) for i in range(SKETCH))


def _open_pairs(open_: DataFrame) -> tuple[int, int]:
    """How many pairs of different components the lists hold, and how many members."""
    of = open_.groupBy("key", "component").agg(F.count("*").cast("double").alias("c")).groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("own"))
    row = of.agg(F.sum((F.col("m") * F.col("m") - F.col("own")) / 2), F.sum("m")).first()
    return int(row[0] or 0), int(row[1] or 0)


def _other_stars(open_: DataFrame, percent: int, seed: int) -> DataFrame:
    """Pairs a < b of the members of a list and size class with a leader of the list's own, of another component."""
    chunks = F.ceil(F.col("m") / BLOCK).cast("int")
    classed = open_.withColumns({"class": _class("n", percent), "chunk": F.pmod(F.xxhash64("id"), chunks).cast("int")})
    facts = F.struct(F.xxhash64("id", "key", F.lit(seed)).alias("h"), *(F.col(c).alias(f"{c}_l") for c in ("id", "n", "component", *(f"s{i}" for i in range(SKETCH)))))
    leaders = classed.groupBy("key", "class").agg(F.min(facts).alias("l"), F.max("m").alias("m")).select("key", "class", "l.*", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    met = classed.join(leaders, ["key", "class", "chunk"]).filter((F.col("component") != F.col("component_l")) & _alike("_l", percent))
    return met.select(F.least("id", "id_l").alias("a"), F.greatest("id", "id_l").alias("b")).distinct()


def _merged(joined: DataFrame, more: DataFrame) -> DataFrame:
    """joined (id, component) after the links more."""
    to = {x: joined.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"}
    between = more.join(to["a"], "a", "left").join(to["b"], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b").distinct()
    again = stored(components(between), "components").select(F.col("id").alias("first"), F.col("component").alias("last"))
    old = joined.join(again, joined["component"] == again["first"], "left").select("id", F.coalesce("last", "component").alias("component"))
    new = again.join(joined, again["first"] == joined["id"], "left_anti").select(F.col("first").alias("id"), F.col("last").alias("component"))
    return stored(old.unionByName(new), "star-components")


def _pairs_within(rows: DataFrame, keys: list[str], percent: int, met_here: Callable[[Callable[[str], Column]], Column] | None = None) -> DataFrame:
    """The pairs a < b of different components that meet in keys and may be linked by their sizes and sketches; apart: bits."""
    other = rows.select(*keys, *(F.col(c).alias(f"{c}_2") for c in rows.columns if c not in keys))
    again = F.lit(False)
    for x in range(1, EARLIER + 1):
        for y in range(1, EARLIER + 1):
            again = again | F.coalesce(F.col(f"p{x}") == F.col(f"p{y}_2"), F.lit(False))
    # The smaller set comes first, and is a strong one.
    wanted = ((F.col("n") < F.col("n_2")) | ((F.col("n") == F.col("n_2")) & (F.col("id") < F.col("id_2")))) & (F.col("component") != F.col("component_2")) & ~again & (F.col("n") <= F.col("reach_2")) & (F.col("n_2") <= F.col("reach")) & _alike("_2", percent)
    if met_here is not None:
        wanted = met_here(lambda c: F.least(c, f"{c}_2")) & wanted
    return rows.filter(STRONG).join(other, keys).filter(wanted).select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b"), _bits_apart("_2").alias("apart"))


def _split(rows: DataFrame, keys: list[str], name: str, percent: int, seed: int) -> DataFrame:
    """rows of lists (keys) dealt once more, by name: the ring around a pivot, and the next inner one.

    Pairs are to be compared in the inner one of their two rings (column `in_`name), where more than one component is.
    """
    chunks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int"))
    each_chunk = F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk")
    pivot = F.min(F.struct(F.xxhash64("id", F.lit(seed)), *(F.col(f"s{i}").alias(f"s{i}_p") for i in range(SKETCH)))).alias("pivot")
    pivots = rows.groupBy(*keys).agg(pivot, F.max("n").alias("top"), F.max("m").alias("m")).select(*keys, "top", *(f"pivot.s{i}_p" for i in range(SKETCH)), each_chunk)
    radius = F.floor(2 * F.col("top") * (100 - percent) / (100 + percent)) + 1
    ring = F.floor(_bits_apart("_p") / radius).cast("int")
    rings = dealt.join(pivots, [*keys, "chunk"]).withColumn(f"in_{name}", ring).select(*rows.columns, "chunk", f"in_{name}", F.explode(F.array(F.col(f"in_{name}"), F.col(f"in_{name}") - 1)).alias(name))
    rings = stored(rings, "rings")
    mixed = rings.groupBy(*keys, name).agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"), F.max("m").alias("m")).filter("x <> y").select(*keys, name, "size", each_chunk)
    return stored(rings.join(mixed, [*keys, name, "chunk"]).drop("chunk").withColumn("m", F.col("size")).drop("size"), "mixed-rings")


def _pairs_of_long_lists(rows: DataFrame, percent: int) -> DataFrame:
    """The same for lists of more than BLOCK sets."""
    keys, inner = ["key", "band"], {"band": "class"}
    rows = rows.withColumn("class", _class("n", percent))
    rows = rows.select(*rows.columns, F.explode(F.array(F.col("class"), F.col("class") - 1)).alias("band"))
    for i in range(PIVOTS):
        rows = _split(rows, keys, f"ring{i}", percent, i + LEADERS)
        keys, inner = [*keys, f"ring{i}"], inner | {f"ring{i}": f"in_ring{i}"}
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int")).select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
    rows = stored(rows.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")}).drop("with"), "blocks")

    def met_here(least: Callable[[str], Column]) -> Column:
        met = (F.col("block") != F.col("block_2")) | (F.col("low") == F.col("high"))
        for key, own in inner.items():
            met = met & (least(own) == F.col(key))
        return met

    return _pairs_within(rows, [*keys, "low", "high"], percent, met_here)


def _likeliest(rest: DataFrame, seed: int) -> DataFrame:
    """Of each set's pairs (a, b, apart) the one with the nearest partner, and the one whose partner is first by a hash."""
    way = lambda x, y: F.struct(F.col(x).alias("id"), F.col(y).alias("other"))
    ways = rest.select("a", "b", "apart", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("w"))
    first = lambda *by: F.min(F.struct(*by, "a", "b"))
    order = F.xxhash64("w.other", F.lit(seed))
    best = ways.groupBy("w.id").agg(first("apart", order).alias("near"), first(order).alias("led"))
    return best.select(F.explode(F.array(*(F.struct(f"{x}.a", f"{x}.b") for x in ("near", "led")))).alias("p")).select("p.*").distinct()


def _settled(joined: DataFrame, rest: DataFrame, prefixes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """joined (id, component) after all links among the distinct pairs rest (a, b, apart).

    Where a set has many pairs the likeliest ones are compared first; pairs that lie in one component afterwards need no
    comparison, and what is left is compared whole. Rounds end when one leaves over half of its pairs.
    """
    for seed in range(ROUNDS):
        ends = _ends(rest)
        pairs, sets = rest.count(), ends.count()
        if pairs <= PAIRS * sets:
            break
        chosen = stored(_likeliest(rest, seed), "likely-pairs")
        joined = _merged(joined, _verified(chosen, prefixes, docs, k, percent))
        hot = hot_keys(ends, ["id"], "n")
        placed = rest.join(chosen, ["a", "b"], "left_anti")
        for x, y in ("ab", "ba"):
            to = _of(joined, ends).select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
            placed = dealt_join(placed, to, [x], hot.withColumnRenamed("id", x), [y], "left")
        rest = stored(placed.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "apart"), "rest-pairs")
        if 2 * rest.count() > pairs:
            break
    return _merged(joined, _verified(rest.select("a", "b"), prefixes, docs, k, percent))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """Per row: id, n_shingles, component_id. Linked: 100 * intersection >= percent * union. Ids are integers."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    seen = stored(_sets(docs, k), "shingle-sets")
    sets = seen.filter(F.col("n").isNotNull()).select("id", "n", "s1", "s2")
    often = seen.filter(F.col("n").isNull()).groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= SHARED)
    got = often.orderBy(F.desc("c"), "h").limit(MAX_SHARED).toArrow()
    keys, counts = got["h"].to_numpy().astype(np.int64).view(np.uint64), got["c"].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    classes = stored(sets.filter("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "set-classes")
    reps = classes.select(F.col("rep").alias("id"))
    prefixes = stored(_prefixes(docs, k, percent, (keys[order], counts[order])).join(reps.distinct(), "id", "left_semi"), "prefixes")

    boundary, hot = _boundary(prefixes, percent)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    lists = stored(_lists(_postings(prefixes, boundary, percent, percent), hot, parts), "lists")

    links = _verified(stored(_stars(lists, percent), "star-pairs"), prefixes, docs, k, percent)
    joined = stored(components(links), "star-components")
    open_ = _open_lists(lists, joined, prefixes)
    pairs, members = _open_pairs(open_)
    for seed in range(ROUNDS):
        if pairs <= PAIRS * members:
            break
        joined = _merged(joined, _verified(stored(_other_stars(open_, percent, seed), "star-pairs"), prefixes, docs, k, percent))
        open_, before = _open_lists(lists, joined, prefixes), pairs
        pairs, members = _open_pairs(open_)
        if 2 * pairs > before:
            break
    rest = _pairs_within(open_.filter(F.col("m") <= BLOCK).drop("m"), ["key"], percent)
    if not (long := open_.filter(F.col("m") > BLOCK)).isEmpty():
        rest = rest.unionByName(_pairs_of_long_lists(long, percent))
    joined = _settled(joined, stored(rest.distinct(), "rest-pairs"), prefixes, docs, k, percent)

    named = classes.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = dealt_join(sets, named, ["s1", "s2"], hot_keys(classes, ["s1", "s2"], "m"), ["id"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
