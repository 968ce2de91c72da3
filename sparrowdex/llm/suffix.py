"""Exact substring dedup: maximal repeats by a common-prefix interval tree over sharded suffix arrays.

Every byte that lies in a string of ``length`` bytes which also starts elsewhere is found. Shards: each window of that
length is filed under its minimizer, the least hash of its ``K``-byte pieces; equal windows have equal minimizers at equal
offsets, so a repeat never crosses shards. Consecutive windows with one minimizer form a run; runs with equal bytes are
one class with a multiplicity. Of every minimizer with several classes, the bytes of each class are gathered, an enhanced
suffix array (order and common prefixes) of their windows is built, and a stack scan yields the intervals of its
common-prefix tree. An interval whose occurrences have different bytes to their left, or stand at the left end of a run,
is a maximal repeat group; its occurrences are what is removed. A class that occurs twice is a leaf of that tree with two
occurrences, and a repeat as it stands. Classes map back to all runs, runs to documents.

The windows of a minimizer with more than ``HOT`` classes are sharded once more: those at SLICE distances from it that
follow each other have all but a few bytes at their ends in common, and go by the hash of these bytes. Equal windows
have equal ones, so these shards have suffix arrays like the others. Where even such a slice has more than ``HOT``
classes, the shard is nearly one string, and its windows are compared by 128-bit hashes in an aggregation, which gives
the same spans. Bit sets of fixed size, broadcast, tell which minimizers are wanted; a bit too many costs work only, and
beyond LOAD minimizers they are told by joins instead. Classes are told apart by the 64-bit hashes of minimizer and run.

Cases: a null text is an empty one; texts shorter than ``length`` bytes lose nothing. Copies remove each other whole: no
occurrence is spared, so no ties arise. Ids are unique or belong to equal rows, which count as copies; a row with a null id counts as a
copy but keeps its text. Extra columns are ignored; an empty
table gives an empty result. Texts are read whole, in chunks that overlap by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, hot_keys, mix, power_table, stored, tidy

#: Bytes of a minimizer's piece, windows of a text hashed at once, classes of a minimizer gathered at most.
K, CHUNK, HOT = 64, 1 << 20, 16384
#: A bit set: so many bits, by the low bits of the hash (the high ones are small in a minimizer).
BITS = 27
#: Of a bit set, hashes at most: beyond, about a bit in eight is set and hashes are compared by joins.
LOAD = 1 << (BITS - 3)
#: Distances from the minimizer that a slice of a hot minimizer's windows spans.
SLICE = 17
#: Windows whose suffixes are sorted at once.
SORTED = 30_000
#: Up to so many bytes of ids and spans are joined by a broadcast.
MAX_BROADCAST = 48_000_000
#: Seeds and bases of the two hashes of strings.
_HASHES = ((7, 0x9E3779B97F4A7C15), (11, 0xC2B2AE3D27D4EB4F))


class Sums:
    """Hashes of the pieces of a string of at most CHUNK + 1024 bytes."""

    def __init__(self, raw: np.ndarray, both: bool = True):
        self.of = [(np.concatenate((np.zeros(1, np.uint64), np.cumsum(v[raw] * p[: len(raw)]))), q) for v, p, q in (power_table(seed, base, CHUNK + 1024) for seed, base in _HASHES[: 1 + both])]

    def get(self, which: int, start, end, salt=0) -> np.ndarray:
        sums, inverse = self.of[which]
        return mix((sums[end] - sums[start]) * inverse[start] + np.asarray(salt, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def runs(raw: np.ndarray, length: int, contexts: bool = True):
    """Of a string: minimizer hash, hash of all bytes, first window, windows and minimizer offset of each run of windows."""
    n, w = len(raw), length - K + 1
    sums = Sums(raw, contexts)
    at = np.arange(n - K + 1)
    h = sums.get(0, at, at + K)
    least = (h & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)
    size = 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    m = n - length + 1
    place = (np.minimum(least[:m], least[w - size : w - size + m]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    windows = np.diff(np.append(first, m))
    offset = place[first] - first
    if not contexts:
        return h[place[first]]
    end, salt = first + windows + length - 1, windows * 1024 + offset
    return h[place[first]], sums.get(1, first, end, salt), first, windows, offset


def _chunks(text: str | None, length: int) -> Iterator[tuple[int, np.ndarray]]:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    step = CHUNK - length
    for at in range(0, max(0, len(raw) - length + 1), step):
        yield at, raw[at : at + step + length - 1]


def maximal_repeats(regions: list[bytes], windows: np.ndarray, offsets: np.ndarray, shard: np.ndarray, length: int, low: int = 0, high: int = 1 << 30) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The maximal repeat groups: common length, and the region and place of each occurrence.

    Suffixes begin at the windows of the regions whose distance from the minimizer is in [low, high); a shard's suffixes
    of equal distance are compared.
    """
    widest = max(map(len, regions))
    text = np.zeros((len(regions), 2 * widest), dtype=np.uint8)
    for row, r in zip(text, regions, strict=True):
        row[: len(r)] = np.frombuffer(r, dtype=np.uint8)
        row[: len(r)] += 1  # UTF-8 has no byte 255; 0 ends a region
    region = np.repeat(np.arange(len(regions)), windows)
    place = np.arange(len(region)) - np.repeat(np.cumsum(windows) - windows, windows)
    near = (offsets[region] - place >= low) & (offsets[region] - place < high)
    region, place = region[near], place[near]
    left = np.where(place > 0, text[region, place - 1], 256 + np.arange(len(region)))
    # A suffix sorts by its shard, its minimizer's distance, its bytes.
    keys = np.empty((len(region), widest + 8), dtype=np.uint8)
    keys[:, :8] = ((shard[region].astype(np.uint64) + 1) << np.uint64(16) | (offsets[region] - place + 1).astype(np.uint64)).astype(">u8").view(np.uint8).reshape(-1, 8) | np.array([128] * 4 + [0] * 4, dtype=np.uint8)
    keys[:, 8:] = np.lib.stride_tricks.sliding_window_view(text, widest, axis=1)[region, place]
    order = np.argsort(keys.view(f"S{widest + 8}").ravel(), kind="stable")
    keys = keys[order]
    region, place, left = region[order], place[order], left[order]
    sizes = np.array([len(r) for r in regions])[region] - place
    differ = keys[1:] != keys[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), widest + 8) - 8
    common = np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))
    diverse = np.concatenate(([0], np.cumsum(left[1:] != left[:-1])))
    out = []

    def close(depth: int, a: int, b: int) -> None:
        if diverse[b] > diverse[a]:
            out.append((depth, region[a : b + 1], place[a : b + 1]))

    long = np.concatenate(([False], common >= length, [False]))
    edges = np.flatnonzero(long[1:] != long[:-1])
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        depths = common[begin:end].tolist()
        if min(depths) == max(depths):
            close(depths[0], begin, end)
            continue
        stack: list[tuple[int, int]] = []  # depth, first suffix
        for i, depth in enumerate([*depths, 0]):
            first = begin + i
            while stack and stack[-1][0] > depth:
                ended, first = stack.pop()
                close(ended, first, begin + i)
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, first))
    return out


def _bit_set(hashes: DataFrame, of: str = "h") -> np.ndarray:
    """The bit set of a column of hashes: at most 2 ** (BITS - 6) words reach the driver."""
    word = F.expr(f"shiftright({of} & {(1 << BITS) - 1}L, 6)").alias("word")
    words = hashes.groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({of} & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _in_set(h: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    """Which hashes are in a bit set; all are in None."""
    if bits is None:
        return np.ones(len(h), dtype=bool)
    bit = h & np.uint64((1 << BITS) - 1)
    return (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _minimizers(docs: DataFrame, length: int) -> DataFrame:
    """h and n: how many runs of a batch have it."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [runs(raw, length, False) for t in batch.column(1) for _, raw in _chunks(t.as_py(), length)]
            h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])

    return docs.mapInArrow(tidy(hashes), "h long, n int")


def _runs_of(docs: DataFrame, length: int, wanted: np.ndarray | None) -> DataFrame:
    """Each run of each document whose minimizer is in the bit set: c tells its bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    names = ["id", "h", "c", "at", "windows"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            ids, cols = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for at, raw in _chunks(text.as_py(), length):
                    h, c, first, windows, _ = runs(raw, length)
                    kept = _in_set(h, bits)
                    if kept.any():
                        ids += [doc_id] * int(kept.sum())
                        cols.append([x[kept] for x in (h.view(np.int64), c.view(np.int64), (first + at).astype(np.int32), windows.astype(np.int16))])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(np.concatenate(x)) for x in zip(*cols, strict=True))], names=names)

    return docs.mapInArrow(tidy(each), "id long, h long, c long, at int, windows short")


#: A class's bytes in a shard k: shift tells where in the class they begin, off and windows as in runs().
_REGION = "k long, h long, c long, shift short, off short, windows short, raw binary"


def _regions(rows: list[tuple]) -> pa.RecordBatch:
    k, h, c, shift, off, windows, raw = zip(*rows, strict=True)
    hashes = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (k, h, c)]
    return pa.RecordBatch.from_arrays([*hashes, *(pa.array(np.array(x, dtype=np.int16)) for x in (shift, off, windows)), pa.array(raw, pa.binary())], names=["k", "h", "c", "shift", "off", "windows", "raw"])


def _class_bytes(docs: DataFrame, length: int, wanted: np.ndarray | None, hot: np.ndarray) -> DataFrame:
    """The regions of the classes of the wanted minimizers that are not hot; a class may come more than once."""
    shared = docs.sparkSession.sparkContext.broadcast((wanted, hot))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, too_many = shared.value
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            rows: list[tuple] = []
            for text in batch.column(1):
                if len(rows) > 10_000:
                    yield _regions(rows)
                    rows = []
                for _, raw in _chunks(text.as_py(), length):
                    h, c, first, windows, offset = runs(raw, length)
                    for i in np.flatnonzero(_in_set(h, many) & ~_in_set(h, too_many)).tolist():
                        key = int(h[i]), int(c[i])
                        if key not in seen:
                            seen.add(key)
                            rows.append((h[i], h[i], c[i], 0, offset[i], windows[i], raw[first[i] : first[i] + windows[i] + length - 1].tobytes()))
            if rows:
                yield _regions(rows)

    return docs.mapInArrow(tidy(each), _REGION)


def _class_bytes_by_join(docs: DataFrame, length: int, classes: DataFrame, shards: DataFrame, hot: np.ndarray) -> DataFrame:
    """The same with the wanted minimizers told by a join: each class is read where its first row with an id is."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    where = classes.join(shards.select("h"), "h", "left_semi").select("c", "h", "spot.id", "spot.at", "windows")
    spots = where.filter("id IS NOT NULL").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "h", "c", "windows"))).alias("spots"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        too_many = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for text, own in zip(batch.column(0), batch.column(1), strict=True):
                raw = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
                for s in own.as_py():
                    h = np.array([s["h"]], dtype=np.int64).view(np.uint64)
                    if _in_set(h, too_many)[0]:
                        continue
                    region = raw[s["at"] : s["at"] + s["windows"] + length - 1]
                    rows.append((h[0], h[0], s["c"] & 0xFFFFFFFFFFFFFFFF, 0, runs(region, length)[4][0], s["windows"], region.tobytes()))
                    if len(rows) > 10_000:
                        yield _regions(rows)
                        rows = []
            if rows:
                yield _regions(rows)

    read = docs.join(spots, "id").select("text", "spots").mapInArrow(tidy(each), _REGION)
    # A class of rows without an id only is read in those.
    nameless = _class_bytes(docs.filter("id IS NULL"), length, None, hot).join(shards.select("h"), "h", "left_semi")
    return read.unionByName(nameless)


def _slices(raw: np.ndarray, sums: Sums, length: int, h: int, first: int, windows: int, offset: int) -> Iterator[tuple[int, int, int, int]]:
    """Of a run of a hot minimizer: shard, shift, offset and windows of each of its slices."""
    for q in range((offset - windows + 1) // SLICE, offset // SLICE + 1):
        low, high = max(q * SLICE, offset - windows + 1), min(q * SLICE + SLICE - 1, offset)
        minimizer = first + offset
        same = sums.get(1, minimizer - q * SLICE, minimizer - q * SLICE - SLICE + 1 + length, q + 1)
        yield int(same ^ mix(np.uint64(h) + np.uint64(q))), offset - high, high, high - low + 1


def _hot_classes(docs: DataFrame, length: int, hot: np.ndarray, shape: str, work) -> DataFrame:
    """What work makes of the slices of the classes of hot minimizers; a class may come more than once."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def slices(batch: pa.RecordBatch) -> Iterator[tuple]:
            seen: set[tuple[int, int]] = set()
            for text in batch.column(1):
                for _, raw in _chunks(text.as_py(), length):
                    h, c, first, windows, offset = runs(raw, length)
                    sums = None
                    for i in np.flatnonzero(_in_set(h, bits)).tolist():
                        key = int(h[i]), int(c[i])
                        if key not in seen:
                            seen.add(key)
                            sums = sums or Sums(raw)
                            for k, shift, off, n in _slices(raw, sums, length, key[0], int(first[i]), int(windows[i]), int(offset[i])):
                                yield k, *key, shift, off, n, int(first[i]) + shift, raw, sums

        for batch in batches:
            yield from work(slices(batch))

    return docs.mapInArrow(tidy(each), shape)


def _hot_spans(docs: DataFrame, length: int, hot: np.ndarray) -> DataFrame:
    """h, c, start, end of the repeats of the classes of hot minimizers: suffix arrays of slices, hashes of crowded ones."""
    sc = docs.sparkSession.sparkContext

    def keys(slices: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        found = np.array([(x[0], x[2]) for x in slices], dtype=np.uint64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, j]).view(np.int64)) for j in (0, 1)], names=["k", "c"])

    counted = _hot_classes(docs, length, hot, "k long, c long", keys).distinct().groupBy("k").agg(F.count("*").alias("n"))
    shards = stored(counted.filter("n > 1"), "slices")
    many, crowded = sc.broadcast(_bit_set(shards, "k")), sc.broadcast(_bit_set(shards.filter(F.col("n") > HOT), "k"))

    def regions(slices: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for k, h, c, shift, off, n, at, raw, _ in slices:
            own = np.array([k], dtype=np.uint64)
            if _in_set(own, many.value)[0] and not _in_set(own, crowded.value)[0]:
                rows.append((k, h, c, shift, off, n, raw[at : at + n + length - 1].tobytes()))
                if len(rows) > 10_000:
                    yield _regions(rows)
                    rows = []
        if rows:
            yield _regions(rows)

    def windows(slices: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = []
        for k, h, c, shift, _, n, at, _, sums in slices:
            if _in_set(np.array([k], dtype=np.uint64), crowded.value)[0]:
                place = at + np.arange(n)
                ids = [np.full(n, x, dtype=np.uint64).view(np.int64) for x in (h, c)]
                cols.append([*ids, (shift + np.arange(n)).astype(np.int32), *(sums.get(j, place, place + length).view(np.int64) for j in (0, 1))])
        if cols:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*cols, strict=True)], names=["h", "c", "place", "w1", "w2"])

    spans = _shard_spans(_hot_classes(docs, length, hot, _REGION, regions), length)
    if crowded.value.any():
        each = _hot_classes(docs, length, hot, "h long, c long, place int, w1 long, w2 long", windows).distinct()
        again = stored(each.groupBy("w1", "w2").agg(F.count("*").alias("t")).filter("t > 1"), "repeated-windows")
        met = dealt_join(each, again.select("w1", "w2"), ["w1", "w2"], hot_keys(again, ["w1", "w2"], "t"), ["h", "c", "place"])
        spans = spans.unionByName(met.select("h", "c", F.col("place").alias("start"), (F.col("place") + length).alias("end")))
    return spans


def _shard_spans(gathered: DataFrame, length: int) -> DataFrame:
    """h, c, start, end of the maximal repeats' occurrences, from a class's first byte on, merged."""

    def spans(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and end of each span of the classes of some shards."""
        regions, windows, offsets = [r[6] for r in rows], np.array([r[5] for r in rows]), np.array([r[4] for r in rows])
        shard = np.unique(np.array([r[0] for r in rows]), return_inverse=True)[1]
        change = np.zeros((len(rows), max(map(len, regions)) + 1), dtype=np.int32)
        # Suffixes are compared at equal distances from the minimizer only: a large shard goes distance by distance.
        first, last = offsets - windows + 1, offsets
        step = max(1, SORTED // len(rows))
        for low in range(int(first.min()), int(last.max()) + 1, step):
            own = np.flatnonzero((first < low + step) & (last >= low))
            if len(own) > 1:
                for depth, region, place in maximal_repeats([regions[i] for i in own], windows[own], offsets[own], shard[own], length, low, low + step):
                    np.add.at(change, (own[region], place), 1)
                    np.add.at(change, (own[region], place + depth), -1)
        cover = np.zeros((len(rows), change.shape[1] + 1), dtype=np.int8)
        cover[:, 1:] = np.cumsum(change, axis=1) > 0
        edge = np.diff(cover, axis=1)
        return np.nonzero(edge == 1)[0], np.nonzero(edge == 1)[1], np.nonzero(edge == -1)[1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            row, start, end = spans(rows)
            h, c = np.array([r[1] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=np.int64)
            shift = np.array([r[3] for r in rows], dtype=np.int64)[row]
            return pa.RecordBatch.from_arrays([pa.array(h[row]), pa.array(c[row]), pa.array((shift + start).astype(np.int32)), pa.array((shift + end).astype(np.int32))], names=["h", "c", "start", "end"])

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:4] == row[:4]:
                    continue
                # A shard's classes (at most HOT) stay together.
                if size > SORTED and held[-1][0] != row[0]:
                    yield out(held)
                    held, size = [], 0
                held.append(row)
                size += row[5]
        if held:
            yield out(held)

    parts = int(gathered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return gathered.select("k", "h", "c", "shift", "off", "windows", "raw").repartition(parts, "k").sortWithinPartitions("k", "h", "c", "shift").mapInArrow(tidy(each), "h long, c long, start int, end int")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """id and spans (start, end: bytes, merged, ascending) of every document with a repeat."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    twice = stored(_minimizers(docs, length).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"), "minimizers")
    if twice.count() <= LOAD:
        found = stored(_runs_of(docs, length, _bit_set(twice)), "runs")
    else:
        found = stored(dealt_join(_runs_of(docs, length, None), twice.select("h"), ["h"], hot_keys(twice, ["h"], "n"), ["id", "at"]), "runs")
    classes = stored(found.groupBy("h", "c").agg(F.count("*").alias("m"), F.first("windows").alias("windows"), F.max(F.struct("id", "at")).alias("spot")), "classes")
    shards = stored(classes.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1"), "shards")
    hot_bits = _bit_set(shards.filter(F.col("k") > HOT))
    few = shards.count() <= LOAD
    spans = _shard_spans(_class_bytes(docs, length, _bit_set(shards), hot_bits) if few else _class_bytes_by_join(docs, length, classes, shards, hot_bits), length)
    if hot_bits.any():
        spans = spans.unionByName(_hot_spans(docs, length, hot_bits))
    # What occurs twice is a repeat from end to end.
    spans = spans.unionByName(classes.filter("m > 1").select("h", "c", F.lit(0).alias("start"), (F.col("windows") + length - 1).cast("int").alias("end")))
    merged = spans.groupBy("h", "c").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    placed = dealt_join(found.filter("id IS NOT NULL").select("id", "h", "c", "at"), merged, ["h", "c"], stored(hot_keys(classes, ["h", "c"], "m"), "hot-classes"), ["id", "at"])
    each = placed.select("id", F.transform("spans", lambda s: F.struct((F.col("at") + s["start"]).alias("start"), (F.col("at") + s["end"]).alias("end"))).alias("spans"))
    together = each.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    # Merge sorted spans: a span that begins after all before it have ended opens a new one.
    kind = "array<struct<start:int,end:int>>"
    merge = f"""aggregate(spans, cast(array() as {kind}), (a, s) -> CASE
      WHEN size(a) = 0 OR element_at(a, -1).end < s.start THEN concat(a, array(s))
      WHEN element_at(a, -1).end >= s.end THEN a
      ELSE concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', s.end))) END)"""
    return stored(together.select("id", F.expr(merge).alias("spans")), "repeated-spans")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """Per row: id, n_bytes, n_removed, spans (removed runs of bytes), kept (the remaining bytes)."""
    found = repeated_spans(df, id_col, text_col, length).withColumnRenamed("id", "__id")
    size = found.agg(F.sum(F.lit(48).cast("long") + 24 * F.size("spans"))).first()[0] or 0
    few = size <= MAX_BROADCAST
    docs = df.select(F.col(id_col), F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    joined = docs.join(F.broadcast(found) if few else found, "__id", "left").select(id_col, "__text", "spans")
    kind = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary"
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            spans = [s or [] for s in batch.column(2).to_pylist()]
            for text, own in zip(batch.column(1), spans, strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                cuts = [0, *(x for s in own for x in (s["start"], s["end"])), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                sizes.append(len(raw))
                removed.append(len(raw) - len(left))
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span_type), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "n_removed", "spans", "kept"])

    return joined.mapInArrow(tidy(each), kind)
