"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import shared_dir, stored

__all__ = ["WS", "dealt_join", "hot_keys", "let", "mix", "power_table", "shared_dir", "stored", "table", "tidy", "words", "worker_cache"]

#: White space of the word rules: space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is hot where more rows have it than CHUNK_ROWS and a MAX_HOT-th of all; there are at most MAX_HOT such keys.
CHUNK_ROWS, MAX_HOT = 256, 100_000


def hot_keys(counted: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Of unique keys and how many rows have them: the hot ones with chunks, into how many parts their rows are dealt."""
    least = max(CHUNK_ROWS, (counted.agg(F.sum(n)).first()[0] or 0) // MAX_HOT)
    return counted.filter(F.col(n) > least).select(*keys, F.ceil(F.col(n) / least).cast("int").alias("chunks"))


def dealt_join(large: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """large joined with small, whose keys are unique; a hot key's rows in large are dealt to its chunks by the columns by.

    hot, of at most MAX_HOT rows, is broadcast; its keys' rows in small are repeated for each chunk, all others are not.
    """
    chunks = F.coalesce("chunks", F.lit(1))
    left = large.join(F.broadcast(hot), keys, "left").withColumn("__chunk", F.pmod(F.xxhash64(*by), chunks).cast("int")).drop("chunks")
    right = small.join(F.broadcast(hot), keys, "left").withColumn("__chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("chunks")
    return left.join(right, [*keys, "__chunk"], how).drop("__chunk")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of text; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_CLASS))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker."""
    import pyspark

    return pyspark.__dict__.setdefault("_sparrowdex_worker_cache", {})


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def power_table(seed: int, base: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and the first powers of an odd base and of its inverse; one for each worker."""
    cache = worker_cache()
    if ("powers", seed, base, size) not in cache:
        powers = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            powers.append(np.cumprod(p))
        cache["powers", seed, base, size] = (np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64), *powers)
    return cache["powers", seed, base, size]


def tidy(work: Callable) -> Callable:
    """work (batches to batches) for mapInArrow; a worker that waits for its next task gives unused memory back."""

    def run(batches):
        yield from work(batches)
        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return run
