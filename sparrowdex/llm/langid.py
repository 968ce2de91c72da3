"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased, each run of other characters than letters becomes one blank, and the n-grams of 1 to 3 characters
are hashed to ``buckets``. Counts of all training documents are summed by language and bucket; the log-probability
matrix (buckets x languages, at most ``max_languages``) is broadcast. Documents are scored in batches: the counts of a
batch are one sparse matrix (row starts, buckets, counts), which is multiplied with the log-probabilities at once.

Cases: a null text, or one without a letter, is `und` with score 0. Ties go to the smaller language name. Training rows
without language or text are left out; without any training row everything is `und`. Repeated rows count as often as
they occur; extra columns are ignored; an empty table gives an empty result. Long texts are read in slices, whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy, worker_cache

#: Characters of a text that are read at once; documents of so many characters together are one sparse matrix.
SLICE = 1 << 20
BATCH = 1 << 18
#: Products of n-grams and languages that are held at once.
CELLS = 4_000_000
#: Odd multipliers of the n-gram hash.
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    cache = worker_cache()
    if "letters" not in cache:
        cache["letters"] = np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)
    return cache["letters"]


def ngram_counts(text: str, buckets: int) -> np.ndarray | None:
    """How often each bucket's n-grams occur in text; None if it has no letter."""
    letters, shift = _letters(), np.uint32(32 - (buckets.bit_length() - 1))
    total, any_letter = None, False
    carry = np.array([32], dtype=np.uint32)
    for at in range(0, len(text), SLICE):
        codes = np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letters[codes]
        any_letter = any_letter or bool(is_letter.any())
        before = np.concatenate((carry[-1:] != 32, is_letter[:-1]))
        keep = is_letter | before
        codes = np.where(is_letter, codes, np.uint32(32))[keep]
        a = np.concatenate((carry, codes))
        n = len(codes)
        if not n:
            continue
        h1 = a * _MIX[0]
        hashes = [h1[-n:]]
        pairs = (a[:-1] * _MIX[1] + h1[1:]) ^ np.uint32(0x9E3779B9)
        hashes.append(pairs[-n:])
        if len(a) > 2:
            hashes.append(((pairs[:-1] * _MIX[2]) + h1[2:])[-n:])
        h = np.concatenate(hashes)
        h = (h ^ (h >> np.uint32(15))) * _MIX[1]
        got = np.bincount(h >> shift, minlength=buckets)
        total = got if total is None else total + got
        carry = a[-2:]
    return total if any_letter else None


def sparse_counts(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram counts of texts as a sparse matrix: row starts, buckets, counts; and which texts have a letter."""
    letters, shift = _letters(), np.uint32(32 - (buckets.bit_length() - 1))
    lower = [t.lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(lower)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # Each text has one separator before it, which is the blank that it begins with.
    starts = np.cumsum([0, *(len(t) + 1 for t in lower)])[:-1]
    row = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(codes))))
    is_letter = letters[codes]
    keep = is_letter | np.concatenate(([False], is_letter[:-1]))
    keep[starts] = True
    a, row = np.where(is_letter, codes, np.uint32(32))[keep], row[keep]
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    at = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    h1 = a * _MIX[0]
    pairs = (a[:-1] * _MIX[1] + h1[1:]) ^ np.uint32(0x9E3779B9)
    grams = [(h1, at >= 1), (np.concatenate((h1[:1], pairs)), at >= 1)]
    if len(a) > 2:
        grams.append((np.concatenate((h1[:2], pairs[:-1] * _MIX[2] + h1[2:])), at >= 2))
    h = np.concatenate([x[there] for x, there in grams])
    h = ((h ^ (h >> np.uint32(15))) * _MIX[1]) >> shift
    rows = np.concatenate([row[there] for _, there in grams])
    key, counts = np.unique(rows * buckets + h, return_counts=True)
    any_letter = np.zeros(len(texts), dtype=bool)
    any_letter[row[a != 32]] = True
    return np.searchsorted(key, np.arange(len(texts) + 1) * buckets), key % buckets, counts, any_letter


def count_matrices(texts: Iterable[str | None], buckets: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse matrices of the texts that have a letter: their places among all, row starts, buckets, counts."""

    def matrix(held: list[tuple[int, str]]):
        starts, where, counts, any_letter = sparse_counts([t for _, t in held], buckets)
        kept = np.flatnonzero(any_letter)
        sizes = np.diff(starts)
        inside = np.repeat(any_letter, sizes)  # texts without letters have no n-grams
        return [held[i][0] for i in kept.tolist()], np.concatenate(([0], np.cumsum(sizes[kept]))), where[inside], counts[inside]

    held, size = [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) > SLICE:
            if (got := ngram_counts(text, buckets)) is not None:
                where = np.flatnonzero(got)
                yield [i], np.array([0, len(where)]), where, got[where]
            continue
        if held and size + len(text) > BATCH:
            yield matrix(held)
            held, size = [], 0
        held.append((i, text))
        size += len(text)
    if held:
        yield matrix(held)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = 1 << 15, alpha: float = 0.5, max_languages: int = 256) -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and a matrix of buckets + 1 rows: log-probabilities, and last the log-priors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for rows, starts, where, counts in count_matrices((t.as_py() for t in batch.column(1)), buckets):
                of = np.array([langs[i] for i in rows], dtype=object)
                for lang in set(of.tolist()):
                    own = sums.setdefault(lang, np.zeros(buckets + 1, dtype=np.int64))
                    mine = np.repeat(of == lang, np.diff(starts))
                    own[:-1] += np.bincount(where[mine], weights=counts[mine], minlength=buckets).astype(np.int64)
                    own[-1] += int((of == lang).sum())
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sums = rows.mapInArrow(tidy(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(max_languages + 1).collect())
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn; raise max_languages")
    got = sums.toArrow()
    counts = np.zeros((buckets + 1, len(languages)))
    index = {x: i for i, x in enumerate(languages)}
    if got.num_rows:
        counts[got["bucket"].to_numpy(), [index[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
    seen = [i for i in range(len(languages)) if counts[-1, i]]
    counts = counts[:, seen]
    if not seen:
        return [], counts
    probabilities = np.log((counts[:-1] + alpha) / (counts[:-1].sum(axis=0) + alpha * buckets))
    return [languages[i] for i in seen], np.vstack((probabilities, np.log(counts[-1] / counts[-1].sum())))


def identify(df: DataFrame, languages: list[str], matrix: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred and score, the posterior probability of lang_pred."""
    shared = df.sparkSession.sparkContext.broadcast((languages, matrix))
    buckets = len(matrix) - 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = shared.value
        for batch in batches:
            best, scores = ["und"] * len(batch), [0.0] * len(batch)
            for rows, starts, where, counts in count_matrices((t.as_py() for t in batch.column(1)), buckets) if names else ():
                if not rows:
                    continue
                # So many languages at once that the products stay within CELLS, however many n-grams and languages there are.
                step = max(1, CELLS // max(1, len(where)))
                parts = [np.add.reduceat(counts[:, None] * logs[:, a : a + step][where], starts[:-1], axis=0) for a in range(0, len(names), step)]
                sums = np.concatenate(parts, axis=1) + logs[-1]
                top = sums.argmax(axis=1)
                sure = 1 / np.exp(sums - sums.max(axis=1)[:, None]).sum(axis=1)
                for i, t, x in zip(rows, top.tolist(), sure.tolist(), strict=True):
                    best[i], scores[i] = names[t], x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(score), f"`{id_col}` {kind}, lang_pred string, score double")


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 5 == 0
