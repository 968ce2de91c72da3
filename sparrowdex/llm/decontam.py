"""Benchmark decontamination with suffix arrays of the training text.

Every batch of documents is a shard: its words become integers (0 for words that no test item has, and between
documents), and a suffix array is built of the places where a run of known words is long enough to hold a window. All
suffixes of the test items are then searched in it together, word by word: each keeps the interval of the array that
starts with its words so far, narrowed by binary search, until the interval is empty. The interval at the length of a
window lists every occurrence of that window; the intervals that the next word narrows or ends list the longest matches.

The test items are the only data that is broadcast, in blocks of at most ``block_words`` words, which the shards meet one
after another; documents are never shuffled. Items of fewer words than a window have blocks of their own, one kind for
each length: the suffix arrays that they need hold nothing but runs of their few words. A longest match is spread over
the places of its interval, longer ones over shorter ones, so its cost is the places of the array and not all matches.

Words are lower-cased (A-Z) runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`. A window is ``window`` consecutive words of an item;
a shorter item, unless it has no words, is one window. Cases: a null text has no words; an item with a null id counts
under the empty id; items with the same id count once; repeated document rows are treated alike; extra columns are
ignored (or carried, if named in keep; columns named like the result's own are not); an empty table of documents gives an empty
result, an empty table of items no hits. Ties: of equally long matches the one that comes first in the items, then in the
document, is the longest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Maps each ASCII byte that is neither a digit nor a lower-case letter to a blank, after lower-casing.
_SPLIT = bytes(i if i >= 0x80 or 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A else 32 for i in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_SPLIT).split() if text else []


class Items:
    """A block of test items: vocabulary, suffixes and windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.names = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        ids = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws] for _, ws in items]
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        self.text = np.array([y for x in ids for y in [*x, 0]], dtype=np.int32)
        starts = np.cumsum(np.append(0, lengths + 1))[:-1]
        self.suffix = np.flatnonzero(self.text)
        self.item = np.repeat(np.arange(len(items)), lengths)
        at = self.suffix - starts[self.item]
        #: Length of the window that begins at each suffix; 0 where none does.
        left = lengths[self.item] - at
        self.window = np.where(left >= window, window, np.where((at == 0), left, 0))
        self.at = at
        self.shortest = int(self.window[self.window > 0].min()) if (self.window > 0).any() else 0
        self.longest = int(lengths.max()) if len(lengths) else 0


def suffix_array(text: np.ndarray, shortest: int, depth: int) -> np.ndarray:
    """The places of text that begin a run of at least `shortest` known words' rest, by their first `depth` words.

    text: integers, 0 ends a run. Sorted by prefix doubling; equal to that depth, places stay in order.
    """
    known = np.concatenate(([0], (text > 0).view(np.int8), [0]))
    edges = np.flatnonzero(np.diff(known))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return np.zeros(0, np.int64)
    sizes = end - begin
    places = np.repeat(begin - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    left = np.repeat(end, sizes) - places
    rank = np.zeros(len(text) + 1, dtype=np.int64)
    rank[places] = np.unique(text[places], return_inverse=True)[1] + 1
    k = 1
    while k < depth:
        after = np.where(left > k, rank[np.minimum(places + k, len(text))], 0)
        kinds, own = np.unique(rank[places] * (len(places) + 1) + after, return_inverse=True)
        rank[places] = own + 1
        if len(kinds) == len(places):
            break
        k *= 2
    order = np.argsort(rank[places], kind="stable")
    return places[order][left[order] >= shortest]


def search(text: np.ndarray, sa: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each test suffix the interval of sa at its window's length (empty if none); and its matches.

    A match (suffix, low, high, words; by words) is an interval that the next word narrows, or ends.
    """
    n = len(items.suffix)
    w_lo, w_hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    active = np.arange(n)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(sa), np.int64)
    padded = np.append(text, 0)
    matches = [np.zeros((4, 0), np.int64)]
    for d in range(items.longest + 1):
        if not len(active):
            break
        if d < items.longest:
            word = items.text[items.suffix[active] + d]
            bounds = []
            for right in (False, True):
                a, b = lo.copy(), hi.copy()
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    got = padded[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + d, len(text))]
                    less = (got <= word if right else got < word) & open_
                    a = np.where(less, mid + 1, a)
                    b = np.where(open_ & ~less, mid, b)
                bounds.append(a)
            found = (word > 0) & (bounds[0] < bounds[1])
        else:
            bounds, found = [lo, hi], np.zeros(len(active), dtype=bool)
        if d >= items.shortest:
            ends = np.flatnonzero(~found | (bounds[0] != lo) | (bounds[1] != hi))
            # Equal suffixes share their intervals; the first one stands for them.
            ends = ends[np.unique(lo[ends] * (len(sa) + 1) + hi[ends], return_index=True)[1]]
            matches.append(np.stack((active[ends], lo[ends], hi[ends], np.full(len(ends), d))))
        active, lo, hi = active[found], bounds[0][found], bounds[1][found]
        whole = items.window[active] == d + 1
        w_lo[active[whole]], w_hi[active[whole]] = lo[whole], hi[whole]
    return w_lo, w_hi, np.concatenate(matches, axis=1)


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which interval, and which place of the suffix array, for every place of the intervals."""
    sizes = hi - lo
    which = np.repeat(np.arange(len(lo)), sizes)
    return which, np.arange(sizes.sum()) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.repeat(lo, sizes)


def scan(docs: list[list[bytes]], blocks: Iterator[Items]) -> list[tuple]:
    """For each document: words, hit runs, ids of the items that occur, longest match (item, its start, start, words)."""
    lengths = np.array([len(x) for x in docs], dtype=np.int64)
    starts = np.cumsum(np.append(0, lengths + 1))
    cover = np.zeros(starts[-1] + 1, dtype=bool)
    names: list[set[str]] = [set() for _ in docs]
    best: list[tuple | None] = [None] * len(docs)
    for items in blocks:
        if not items.shortest or not docs:
            continue
        get = items.vocabulary.get
        text = np.zeros(starts[-1], dtype=np.int32)
        for s, n, ws in zip(starts.tolist(), lengths.tolist(), docs, strict=False):
            if n >= items.shortest:
                text[s : s + n] = [get(w, 0) for w in ws]
        sa = suffix_array(text, items.shortest, items.longest)
        if not len(sa):
            continue
        w_lo, w_hi, matches = search(text, sa, items)
        has = np.flatnonzero(w_hi > w_lo)
        if not len(has):
            continue
        # Equal windows of several items share an interval, which is spread once.
        own, which = np.unique(np.stack((w_lo[has], w_hi[has], items.window[has])), axis=1, return_inverse=True)
        interval, place = _expand(own[0], own[1])
        at = sa[place]
        change = np.zeros(len(cover) + 1, dtype=np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + own[2][interval], -1)
        cover |= np.cumsum(change)[: len(cover)] > 0
        doc = np.searchsorted(starts, at, side="right") - 1
        of: list[set[str]] = [set() for _ in range(own.shape[1])]
        for i, k in zip(items.item[has].tolist(), which.ravel().tolist(), strict=True):
            of[k].add(items.names[i])
        for d, k in zip(*(x.tolist() for x in np.divmod(np.unique(doc * len(of) + interval), len(of))), strict=True):
            names[d] |= of[k]
        # Longer matches lie inside the intervals of their shorter beginnings and are painted over them.
        over = np.full(len(sa), -1, dtype=np.int64)
        for k, (a, b) in enumerate(matches[1:3].T.tolist()):
            over[a:b] = k
        place = np.flatnonzero(over >= 0)
        which, length = matches[0, over[place]], matches[3, over[place]]
        doc = np.searchsorted(starts, sa[place], side="right") - 1
        order = np.lexsort((sa[place], which, -length, doc))
        order = order[np.unique(doc[order], return_index=True)[1]]
        for d, i, at, size in zip(doc[order].tolist(), which[order].tolist(), sa[place[order]].tolist(), length[order].tolist(), strict=True):
            if best[d] is None or best[d][3] < size:
                best[d] = (items.names[items.item[i]], int(items.at[i]), int(at - starts[d]), size)
    out = []
    for d, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=False)):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], cover[s : s + n].view(np.int8), [0])))) if names[d] else np.zeros(0, np.int64)
        out.append((n, edges.reshape(-1, 2).tolist(), sorted(names[d]), best[d]))
    return out


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 2_000_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the columns named in keep, n_words, hits (runs of hit words: start, end), items (ids, sorted as strings), longest.

    longest: item, item_start, start, n_words of the longest verbatim match with an item; null if nothing is hit.
    """
    keep = tuple(c for c in dict.fromkeys(keep) if c not in (id_col, "n_words", "hits", "items", "longest"))
    sc = df.sparkSession.sparkContext
    blocks = []
    held: dict[int, tuple[list, int]] = {}  # by the length of their windows
    for name, text in benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(item_text_col)).toLocalIterator():
        ws = words(text)
        if not ws:
            continue
        kind = min(len(ws), window)
        items, size = held.pop(kind, ([], 0))
        if items and size + len(ws) > block_words:
            blocks.append(sc.broadcast(Items(items, window)))
            items, size = [], 0
        items.append((name, ws))
        held[kind] = items, size + len(ws)
    for items, _ in held.values():
        blocks.append(sc.broadcast(Items(items, window)))

    def each_block() -> Iterator[Items]:
        for b in blocks:
            yield b.value
            if len(blocks) > 1:
                b.__dict__.pop("_value", None)  # read again for the next shard: one block is held at a time

    cols = [id_col, *keep]
    kind = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols) + ", n_words long, hits array<struct<start:int,end:int>>, items array<string>, longest struct<item:string,item_start:int,start:int,n_words:int>"
    hit_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    best_type = pa.struct([("item", pa.string()), ("item_start", pa.int32()), ("start", pa.int32()), ("n_words", pa.int32())])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scan([words(t.as_py()) for t in batch.column(len(cols))], each_block())
            hits = [[{"start": a, "end": b} for a, b in f[1]] for f in found]
            longest = [f[3] and dict(zip(("item", "item_start", "start", "n_words"), f[3], strict=True)) for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f[0] for f in found], pa.int64()), pa.array(hits, hit_type), pa.array([f[2] for f in found], pa.list_(pa.string())), pa.array(longest, best_type)], names=[*cols, "n_words", "hits", "items", "longest"])

    return df.select(*cols, F.col(text_col).alias("__text")).mapInArrow(tidy(shard), kind)
