"""Token-id shards in patched frame-of-reference blocks.

File format (little-endian). ``TPF1``; then blocks of BLOCK ids (the last may be shorter); then the document index, an
int64 id and a uint64 number of ids for each document; then the block index, the uint64 file offset of each block; then
the footer ``<QQQQ4s``: ids, documents, blocks, offset of the document index, ``TPF1``. A block is the header ``<IBHH``
(minimum, width, ids, exceptions), the low ``width`` bits of each id minus the minimum, bit by bit from the lowest, and
the exceptions: their uint16 positions, then their uint32 differences in full. The width is the least that holds the
given percentile of the block's differences, so a few large ids do not widen the others.

Documents are range-partitioned and sorted by id; each partition writes one file under a name of its own attempt, and
the stored manifest names only files of attempts that succeeded: a lost executor leaves at most a file that nobody
names. ``start`` follows from the manifest, one short row for each file.

Cases: a null text is an empty one and yields the end id alone. Rows with the same id are all written, in order of their
text. Extra columns are ignored. An empty table gives no files and an empty result. Long texts are encoded whole.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored, tidy, worker_cache

BLOCK = 256
MAGIC = b"TPF1"
HEADER_FORMAT, FOOTER_FORMAT = "<IBHH", "<QQQQ4s"
HEADER_SIZE, FOOTER_SIZE = struct.calcsize(HEADER_FORMAT), struct.calcsize(FOOTER_FORMAT)
#: Ids that a writer or reader holds at once, about.
BUFFER = 1 << 18
#: Pieces of text whose ids a worker remembers, and bytes that are cut into pieces at once.
REMEMBERED, WINDOW = 1_600_000, 1 << 20
#: Bytes of a piece that the arrays below hold; longer ones stand in a dictionary.
SHORT = 16
LETTER, OTHER, SPACE = 1, 2, 3


def _class_table() -> np.ndarray:
    """The class of each code point that pieces may hold, 0 for all others: Latin letters, white space, common marks."""
    out = np.zeros(0x2100, dtype=np.uint8)
    # Ranges of code points.
    for low, high in ((0x21, 0x7E), (0xA1, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF)):
        out[low : high + 1] = OTHER
    for low, high in ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)):
        out[low : high + 1] = LETTER
    out[[0x09, 0x0A, 0x0D, 0x20]] = SPACE
    return out


_CLASS = _class_table()


def _classes(raw: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8 text: that of its character."""
    out = _CLASS[raw]
    for at in range(0, len(raw), WINDOW):
        lead = at + np.flatnonzero(raw[at : at + WINDOW] >= 0xC0)
        if not len(lead):
            continue
        first, second = raw[lead].astype(np.int64), raw[lead + 1].astype(np.int64) & 0x3F
        third = raw[np.minimum(lead + 2, len(raw) - 1)].astype(np.int64) & 0x3F
        point = np.where(first < 0xE0, (first & 0x1F) << 6 | second, (first & 0xF) << 12 | second << 6 | third)
        kind = np.where((first < 0xF0) & (point < len(_CLASS)), _CLASS[np.minimum(point, len(_CLASS) - 1)], 0)
        out[lead], out[lead + 1] = kind, kind
        three = (first >= 0xE0) & (lead + 2 < len(raw))
        out[lead[three] + 2] = kind[three]
    return out


def _cuts(raw: np.ndarray, kind: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where pieces begin in a window that begins with one; edges: where texts begin.

    A piece is a run of letters with the blank before it, or a run of others (with a blank, and with the letters of a
    contraction), or white space but its last character, or that one.
    """
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[0], before[1:] = 0, kind[:-1]
    after[-1], after[:-1] = 0, kind[1:]
    before[edges] = 0
    after[edges[edges > 0] - 1] = 0
    last = np.empty_like(raw)
    last[0], last[1:] = 0, raw[:-1]
    inside = (before == SPACE) & (last == 0x20) | (kind == LETTER) & (before == OTHER) & (last == 0x27)
    return np.flatnonzero((kind != before) & ~inside | (kind == SPACE) & (before == SPACE) & (after != 0) & (after != SPACE))


class Memory:
    """The ids of pieces of up to SHORT bytes, found by their bytes (two integers) with open addressing; and of longer ones."""

    def __init__(self):
        self.slots = np.full(1 << 16, -1, dtype=np.int32)
        self.a, self.b = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint64)
        self.first, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.n, self.used = 0, 0
        self.long: dict[bytes, int] = {}

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - (len(self.slots).bit_length() - 1))).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The entry of each piece, -1 for unknown ones."""
        slot = self._slot(a, b)
        out = self.slots[slot]
        wrong = np.flatnonzero((out >= 0) & ((self.a[out] != a) | (self.b[out] != b)))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.slots) - 1)
            got = self.slots[slot[wrong]]
            out[wrong] = got
            wrong = wrong[(got >= 0) & ((self.a[got] != a[wrong]) | (self.b[got] != b[wrong]))]
        return out

    def _place(self, entries: np.ndarray) -> None:
        slot = self._slot(self.a[entries], self.b[entries])
        left = np.arange(len(entries))
        while len(left):
            free = left[self.slots[slot[left]] < 0]
            self.slots[slot[free]] = entries[free]
            left = left[self.slots[slot[left]] != entries[left]]
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)

    def add(self, ids: list[list[int]], a: np.ndarray | None = None, b: np.ndarray | None = None) -> np.ndarray:
        """New entries; without a and b they are found by their number only."""
        new = np.arange(self.n, self.n + len(ids))
        while self.n + len(ids) > len(self.a):
            self.a, self.b, self.first, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.a, self.b, self.first, self.count))
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.array([i for x in ids for i in x], dtype="<u4")
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.first[new], self.count[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.n, self.used = self.n + len(ids), self.used + len(flat)
        if a is not None:
            self.a[new], self.b[new] = a, b
            if 3 * self.n > len(self.slots):
                old = self.slots[self.slots >= 0]
                self.slots = np.full(1 << (4 * self.n).bit_length(), -1, dtype=np.int32)
                self._place(old)
            self._place(new)
        return new


#: The byte-level alphabet: printed Latin-1 bytes stand for themselves, the others for characters from 256 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_ALPHABET = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}


class Encoder:
    """A tokenizer of the tokenizers library with the ids of the pieces that it has met.

    Byte-level BPE splits a text before it merges. Latin texts are cut into pieces at places where it always splits; the
    library's model merges the letters of a new piece, the library encodes any other new piece whole. Texts with other
    characters or an added token go whole, and so do all texts of a tokenizer that does not split like that.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values() if t.content]
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        split, model = kind.get("pre_tokenizer") or {}, kind["model"]
        self.cuts = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
            and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and not any(kind.get(x) for x in ("normalizer", "truncation", "padding"))
        )
        self.memory = Memory()

    def _text(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids if text else [], dtype="<u4")

    def _learn(self, pieces: list[bytes]) -> list[list[int]]:
        merge = self.whole.model.tokenize
        out: list = [[t.id for t in merge(p.decode("latin-1").translate(_ALPHABET))] if p.decode().removeprefix(" ").isalpha() else None for p in pieces]
        other = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(other, self.whole.encode_batch_fast([pieces[i].decode() for i in other], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _entries(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each piece of a window; unknown ones are learned."""
        memory = self.memory
        words = np.concatenate((raw, np.zeros(32 - len(raw) % 8, np.uint8))).view("<u8")
        at, shift = start >> 3, ((start & 7) << 3).astype(np.uint64)
        one, two, three = words[at], words[at + 1], words[at + 2]
        up = np.uint64(63) - shift
        a = (one >> shift | (two << np.uint64(1)) << up) & _MASKS[np.minimum(size, 8)]
        b = (two >> shift | (three << np.uint64(1)) << up) & _MASKS[np.clip(size - 8, 0, 8)]
        out = memory.find(a, b)
        long = np.flatnonzero(size > SHORT)
        out[long] = 0
        if len(new := np.flatnonzero(out < 0)):
            order = new[np.lexsort((b[new], a[new]))]
            first = np.concatenate(([True], (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])))
            own = order[first]
            known = memory.add(self._learn([raw[s : s + n].tobytes() for s, n in zip(start[own].tolist(), size[own].tolist(), strict=True)]), a[own], b[own])
            out[order] = known[np.cumsum(first) - 1]
        for i in long.tolist():
            piece = raw[start[i] : start[i] + size[i]].tobytes()
            if piece not in memory.long:
                memory.long[piece] = int(memory.add(self._learn([piece]))[0])
            out[i] = memory.long[piece]
        return out

    def _latin(self, texts: list[bytes]) -> list[np.ndarray | None]:
        """The ids of each text, None for those that have to go whole."""
        raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        kind = _classes(raw)
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(kind == 0), side="right")).tolist()
        if odd:
            out: list[np.ndarray | None] = [None] * len(texts)
            good = sorted(set(range(len(texts))) - set(odd))
            for i, ids in zip(good, self._latin([texts[i] for i in good]) if good else [], strict=True):
                out[i] = ids
            return out
        edges = np.concatenate(([0], ends))
        at, window, starts, counts, parts = 0, WINDOW, [], [], []
        while at < len(raw):
            end = min(len(raw), at + window)
            own = edges[np.searchsorted(edges, at) : np.searchsorted(edges, end)] - at
            cut = _cuts(raw[at:end], kind[at:end], own)
            if end < len(raw):
                cut = cut[cut < end - at - 1]  # what comes next decides about the last byte
                if len(cut) < 2:
                    window *= 2
                    continue
                end = at + int(cut[-1])
            else:
                cut = np.append(cut, end - at)
            if self.memory.n > REMEMBERED:
                self.memory = Memory()
            entry = self._entries(raw[at:end], cut[:-1], np.diff(cut))
            count = self.memory.count[entry]
            upto = np.cumsum(count)
            parts.append(self.memory.ids[np.repeat(self.memory.first[entry] - upto + count, count) + np.arange(upto[-1])])
            starts.append(cut[:-1] + at)
            counts.append(count)
            at, window = end, WINDOW
        if not parts:
            return [np.zeros(0, "<u4") for _ in texts]
        ids, upto = np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        bounds = upto[np.searchsorted(np.concatenate(starts), edges)].tolist()
        return [ids[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as the tokenizers library gives them, uint32."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        cut = [i for i, t in enumerate(raw) if self.cuts and not any(x in t for x in self.added)]
        got = dict(zip(cut, self._latin([raw[i] for i in cut]) if cut else [], strict=True))
        return [x if (x := got.get(i)) is not None else self._text(t or "") for i, t in enumerate(texts)]


#: The lowest bytes of an integer, by their number.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def tokenizer(path: str) -> Encoder:
    """The encoder of a tokenizer's file, one for each worker."""
    cache = worker_cache()
    if ("tokenizers", path) not in cache:
        cache["tokenizers", path] = Encoder(path)
    return cache["tokenizers", path]


def encode_batch(texts: list[str | None], path: str) -> list[np.ndarray]:
    """The ids of each text as the tokenizers library gives them, uint32."""
    return tokenizer(path).encode(texts)


def _low_bits(rows: np.ndarray, width: int) -> np.ndarray:
    """The lowest `width` bits of each value (uint32), row by row, as packed bytes: 64 values fill `width` integers."""
    k, n = rows.shape
    values = np.zeros((k, -(-n // 64) * 64), dtype=np.uint64)
    values[:, :n] = rows & np.uint32((1 << width) - 1)
    columns = np.ascontiguousarray(values.reshape(-1, 64).T)
    out = np.zeros((width, columns.shape[1]), dtype="<u8")
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        out[word] |= columns[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).view(np.uint8).reshape(k, -1)[:, : (n * width + 7) // 8]


def _from_bits(packed: np.ndarray, n: int, width: int) -> np.ndarray:
    """The n values of `width` bits of each row of packed bytes (uint32)."""
    k, groups = len(packed), -(-n // 64)
    raw = np.zeros((k, groups * width * 8), dtype=np.uint8)
    raw[:, : packed.shape[1]] = packed
    words = np.ascontiguousarray(raw.view("<u8").reshape(-1, width).T)
    out = np.empty((64, words.shape[1]), dtype=np.uint32)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value |= words[word + 1] << np.uint64(64 - shift)
        out[j] = value & np.uint64((1 << width) - 1)
    return np.ascontiguousarray(out.T).reshape(k, -1)[:, :n]


def pack(ids: np.ndarray, percentile: float = 90.0) -> list[bytes]:
    """The blocks of ids, in order."""
    full = len(ids) // BLOCK
    out: list[bytes] = [b""] * full
    if full:
        blocks = ids[: full * BLOCK].reshape(full, BLOCK)
        low = blocks.min(axis=1)
        diff = (blocks - low[:, None]).astype(np.uint32)
        at = min(BLOCK - 1, int(np.ceil(percentile / 100 * BLOCK)) - 1)
        bound = np.partition(diff, at, axis=1)[:, at]
        widths = np.frexp(bound.astype(np.float64))[1].astype(np.int64)
        for width in np.unique(widths):
            own = np.flatnonzero(widths == width)
            part = diff[own]
            packed = _low_bits(part, int(width))
            row, odd = np.nonzero(part >> np.uint32(width)) if width < 32 else (np.zeros(0, np.int64),) * 2
            ends = np.cumsum(np.bincount(row, minlength=len(own))).tolist()
            places, values, start = odd.astype("<u2").tobytes(), part[row, odd].astype("<u4").tobytes(), 0
            for i, least, bits, end in zip(own.tolist(), low[own].tolist(), packed, ends, strict=True):
                out[i] = struct.pack(HEADER_FORMAT, least, int(width), BLOCK, end - start) + bits.tobytes() + places[2 * start : 2 * end] + values[4 * start : 4 * end]
                start = end
    rest = ids[full * BLOCK :]
    if len(rest):
        low = int(rest.min())
        diff = (rest - np.uint32(low)).astype(np.uint32)
        width = int(np.partition(diff, (k := int(np.ceil(percentile / 100 * len(diff))) - 1))[k]).bit_length()
        odd = np.flatnonzero(diff >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
        out.append(struct.pack(HEADER_FORMAT, low, width, len(rest), len(odd)) + _low_bits(diff[None], width).tobytes() + odd.astype("<u2").tobytes() + diff[odd].astype("<u4").tobytes())
    return out


def unpack(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at the given offsets of data, uint32."""
    heads = [struct.unpack_from(HEADER_FORMAT, data, s) for s in starts.tolist()]
    counts = np.array([h[2] for h in heads], dtype=np.int64)
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint32)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, h in enumerate(heads):
        kinds.setdefault((h[1], h[2]), []).append(i)
    for (width, n), own in kinds.items():
        size = (n * width + 7) // 8
        at = (starts[own] + HEADER_SIZE).tolist()
        if width:
            values = _from_bits(np.frombuffer(b"".join([data[p : p + size] for p in at]), dtype=np.uint8).reshape(len(own), size), n, width)
        else:
            values = np.zeros((len(own), n), dtype=np.uint32)
        odd = [heads[i][3] for i in own]
        places = np.frombuffer(b"".join([data[p + size : p + size + 2 * x] for p, x in zip(at, odd, strict=True)]), "<u2")
        values[np.repeat(np.arange(len(own)), odd), places] = np.frombuffer(b"".join([data[p + size + 2 * x : p + size + 6 * x] for p, x in zip(at, odd, strict=True)]), "<u4")
        low = np.array([heads[i][0] for i in own], dtype=np.uint32)
        out[(ends[own] - n)[:, None] + np.arange(n)] = values + low[:, None]
    return out


def _open(path: str):
    """The file system and the path in it; a scheme that pyarrow knows, or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path)) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


class Writer:
    """Writes one file; ids of a document go in with add()."""

    def __init__(self, path: str, percentile: float):
        self.path, self.percentile = path, percentile
        system, inner = _open(path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(inner, compression=None)
        self.out.write(MAGIC)
        self.at, self.held, self.n_held, self.n_ids = len(MAGIC), [], 0, 0
        self.blocks: list[int] = []
        self.docs: list[tuple[int, int]] = []

    def add(self, doc_id: int, *ids: np.ndarray) -> None:
        n = sum(map(len, ids))
        self.docs.append((doc_id, n))
        self.held += ids
        self.n_held += n
        if self.n_held >= BUFFER:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        ready = len(ids) if last else len(ids) // BLOCK * BLOCK
        for block in pack(ids[:ready], self.percentile):
            self.blocks.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.held, self.n_held = [ids[ready:]], len(ids) - ready
        self.n_ids += ready

    def close(self) -> tuple[int, int]:
        self._flush(True)
        self.out.write(np.array(self.docs, dtype=[("id", "<i8"), ("n", "<u8")]).tobytes())
        self.out.write(np.array(self.blocks, dtype="<u8").tobytes())
        self.out.write(struct.pack(FOOTER_FORMAT, self.n_ids, len(self.docs), len(self.blocks), self.at, MAGIC))
        self.out.close()
        return self.n_ids, len(self.docs)


def read_documents(path: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, start within the file, ids) of each document of a file, in order."""
    system, inner = _open(path)
    with system.open_input_file(inner) as f:
        size = f.size()
        n_ids, n_docs, n_blocks, docs_at, magic = struct.unpack(FOOTER_FORMAT, f.read_at(FOOTER_SIZE, size - FOOTER_SIZE))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        docs = np.frombuffer(f.read_at(16 * n_docs, docs_at), dtype=[("id", "<i8"), ("n", "<u8")])
        blocks = np.append(np.frombuffer(f.read_at(8 * n_blocks, docs_at + 16 * n_docs), dtype="<u8").astype(np.int64), docs_at)
        held, at, step = np.zeros(0, np.uint32), 0, max(1, BUFFER // BLOCK)
        done = 0
        for doc_id, n in docs.tolist():
            while len(held) < n:
                stop = min(n_blocks, at + step)
                data = f.read_at(int(blocks[stop] - blocks[at]), int(blocks[at]))
                held = np.concatenate((held, unpack(data, blocks[at:stop] - blocks[at])))
                at = stop
            yield doc_id, done, held[:n]
            held, done = held[n:], done + n


def write_shards(df: DataFrame, tokenizer_path: str, out_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, percentile: float = 90.0, partitions: int | None = None) -> DataFrame:
    """Encode, append end_id and write; returns the stored manifest: part, path, n_ids, n_docs, ascending by part."""
    spark = df.sparkSession
    base = f"{out_dir or shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, writer, end = TaskContext.get().partitionId(), None, np.array([end_id], dtype="<u4")
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 1024):
                for doc_id, got in zip(ids[at : at + 1024].to_pylist(), encode_batch(texts[at : at + 1024].to_pylist(), tokenizer_path), strict=True):
                    writer = writer or Writer(f"{base}/part-{part:06d}-{uuid.uuid4().hex}.tpf", percentile)
                    writer.add(doc_id, got, end)
        if writer:
            n_ids, n_docs = writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "path": pa.array([writer.path]), "n_ids": pa.array([n_ids], pa.int64()), "n_docs": pa.array([n_docs], pa.int64())})

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    return stored(dealt.mapInArrow(tidy(write), "part long, path string, n_ids long, n_docs long"), "token-manifest")


def read_shards(manifest: DataFrame, id_col: str = "doc_id", ids: bool = False) -> DataFrame:
    """Per document, read from the files: id, start, n_tokens, ids_crc32, and with ids=True the ids."""
    spark = manifest.sparkSession
    files = manifest.orderBy("part").toArrow()
    starts = np.cumsum([0, *files["n_ids"].to_pylist()]).tolist()
    rows = list(zip(files["path"].to_pylist(), starts, strict=False))
    kind = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "start", "n_tokens", "ids_crc32", *["ids"] * ids]

        def out(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.list_(pa.int64())) for c in cols[4:])], names=names)

        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = []
                for doc_id, start, got in read_documents(path):
                    held.append((doc_id, base + start, len(got), zlib.crc32(np.ascontiguousarray(got, dtype="<u4")), *[got.astype(np.int64)] * ids))
                    if len(held) >= 4096:
                        yield out(held)
                        held = []
                if held:
                    yield out(held)

    listed = spark.createDataFrame(rows, "path string, base long") if rows else spark.createDataFrame([], "path string, base long")
    return listed.repartition(max(1, len(rows))).mapInArrow(tidy(read), kind)
