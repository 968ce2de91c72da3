"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A long text is cut at safe boundaries first: before a run of blanks, tabs or newlines whose left neighbour is no white
space. No match of the splitting pattern crosses such a place, and what a match looks ahead at lies in its own piece, so
the ids of the pieces are the ids of the text. A stretch without such a place is matched by the regex module and its
matches are encoded one by one. Ids are decoded to raw bytes, never through a string.

Cases: a null text encodes like an empty one. Repeated rows encode alike, and no ties can arise; extra columns are
ignored (or carried, if named in keep; columns named like the result's own are not); an empty table gives an empty result. Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, worker_cache

#: Texts over so many characters are cut; pieces have about so many, and stretches of this length count as hard.
LONG = 1 << 16
_SAFE = re.compile(r"(?<=\S)(?<![\x1c-\x1f\x85])[ \t\n]")


def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, one for each worker."""
    cache = worker_cache()
    key = ("tiktoken", rank_file, pattern)
    if key not in cache:
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        cache[key] = tiktoken.Encoding(rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return cache[key]


def pieces(text: str, long: int = LONG) -> Iterator[str]:
    """text in pieces of about `long` characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > long:
        cut = _SAFE.search(text, at + long)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, enc, pattern: str, long: int = LONG) -> list[int]:
    if not text:
        return []
    if len(text) <= long:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text, long):
        if len(piece) <= 4 * long:
            ids += enc.encode_ordinary(piece)
        else:
            import regex

            for m in regex.finditer(pattern, piece):
                ids += enc._encode_single_piece(m.group())
    return ids


def bpe_encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the columns named in keep, n_tokens, and ids (array<int>) and/or digests.

    Digests: ids_sha256 over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the decoded bytes.
    """
    cols = [id_col, *(c for c in dict.fromkeys(keep) if c not in (id_col, "n_tokens", "ids", "ids_sha256", "decoded_sha256"))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            n, found, sha, back = [], [], [], []
            for text in batch.column(batch.num_columns - 1):
                got = encode(text.as_py(), enc, pattern)
                n.append(len(got))
                if ids:
                    found.append(np.asarray(got, dtype=np.int32))
                if digests:
                    sha.append(hashlib.sha256(np.asarray(got, dtype="<u4").tobytes()).hexdigest())
                    back.append(hashlib.sha256(enc.decode_bytes(got)).hexdigest())
            out = [*batch.columns[:-1], pa.array(n, pa.int64())]
            if ids:
                out.append(pa.array(found, pa.list_(pa.int32())))
            if digests:
                out += [pa.array(sha, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=names)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*cols).schema] + ["n_tokens long"] + ["ids array<int>"] * ids + ["ids_sha256 string", "decoded_sha256 string"] * digests
    names = [*cols, "n_tokens", *["ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests]
    return df.select(*cols, F.col(text_col).alias("__text")).mapInArrow(tidy(each), ", ".join(kinds))


def decode(ids: list[int], rank_file: str, pattern: str) -> bytes:
    """The raw bytes of ids."""
    return encoding(rank_file, pattern).decode_bytes(ids)
