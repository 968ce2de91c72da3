"""Divergence of the sources of a language: sums of absolute differences of smoothed term shares, for all pairs exactly.

The distance of two sources starts from that of their shares of an absent term, for all terms. A term that many of a
language's sources have is heavy: the shares of a tile's terms in two blocks of sources are laid out as dense numpy tiles, and
tile after tile adds what its terms change. All other terms are light: nearly all sources have only the share of an absent
term, and what changes are the terms that one source has (running sums over its different shares, read off at every other
source's absent share) and the terms that two have (pairs of postings). All sums are whole numbers and add up to the exact
distance.
The boundary is where pairs of postings cost as much as a row of tiles (HEAVY).

Sizes: a term has at most a posting for each source; hot sources and languages are counted in the tasks that read them, so
a posting is one row for a batch of texts at most. Tiles are dealt by hashes of their terms. Listing a source's distances to
all others of its language is the result itself; nothing larger is made.

A null text has no terms; a null language or source is the empty one. A group without terms is listed and has the share of
absent terms for all. Repeated rows count each. Extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt_join, hot_keys, stored, tidy

#: A term is heavy where at least one of so many sources of its language has it.
HEAVY = 4
#: Terms of a tile: as many as its language has sources, within these bounds, so that its sums are no more than its cells. Sources of a block.
LEAST_TILE, TILE, BLOCK = 128, 512, 256
#: Groups (language and source) are broadcast up to so many; beyond, they are joined, with hot ones dealt.
BROADCAST_GROUPS = 50_000
#: A worker's counts are handed on after so many terms, its pairs after so many; texts are cut (between terms) at so many bytes.
FLUSH_TERMS, FLUSH_PAIRS, PART_BYTES = 200_000, 1_000_000, 1 << 20
#: The best terms of a group are found among those of so many parts of it.
SALTS = 64

#: Terms are the runs of bytes that stay: letters, lower-cased, and all beyond ASCII.
_TABLE = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """Lists of the terms of a text in UTF-8, each of a bounded part of it."""
    at, clean = 0, text.translate(_TABLE)
    while len(clean) - at > PART_BYTES:
        end = clean.find(b" ", at + PART_BYTES)
        if end < 0:
            break
        yield clean[at:end].split()
        at = end
    yield clean[at:].split()


def _counts(batches):
    """Batches of lang, source, text to lang, source, term, n, docs; a row for each group and term of as many texts as are held at once."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():
        keys, terms, ns, ds = [], [], [], []
        for key, (n, docs) in found.items():
            keys += [key] * len(n)
            terms += n.keys()
            ns += n.values()
            ds += map(docs.__getitem__, n)
        found.clear()
        named = [pa.array([k[c] for k in keys], pa.string()) for c in (0, 1)]
        return pa.RecordBatch.from_arrays([*named, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64()), pa.array(ds, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    held = 0
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for part in _terms(text.as_buffer().to_pybytes()):
                n.update(part)
                seen.update(part)
            docs.update(seen)
            held += len(n) - before
            if held > FLUSH_TERMS:
                yield rows()
                held = 0
    if held:
        yield rows()


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1,000,000,000 * (n + 5) / (total + 5 * kept)) by long division, three digits at a time; null where no term is kept."""
    down = F.nullif(total + 5 * kept, F.lit(0))
    out, rest = F.lit(1).cast("long"), n + 5
    for scale in (1_000_000, 1_000, 1):
        out = out + scale * F.call_function("div", 1000 * rest, down)
        rest = 1000 * rest % down
    return out


def postings(df: DataFrame, lang_col: str, source_col: str, text_col: str, min_docs: int) -> DataFrame:
    """lang, source, term, n of the terms in at least min_docs of their language's rows, with lang_n (in the language), m (sources that have it) and first (one row of each term)."""
    rows = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counted = rows.mapInArrow(tidy(_counts), "lang string, source string, term string, n bigint, docs bigint").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    spread = counted.withColumns({"lang_docs": F.sum("docs").over(w), "lang_n": F.sum("n").over(w), "m": F.count("*").over(w), "first": F.col("source") == F.min("source").over(w)})
    return stored(spread.filter(F.col("lang_docs") >= min_docs).drop("docs", "lang_docs"), "divergence-postings")


def groups(df: DataFrame, found: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """A row for each occurring lang and source.

    i (its place in the language), s (sources of the language), total, lang_total and kept (terms), rows (postings), base
    (the share of an absent term), and tiles (of the language's heavy terms).
    """
    named = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))))
    seen = stored(named.distinct(), "divergence-seen")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    spread = found.filter("first").groupBy("lang", "m").agg(F.count("*").alias("c")).join(seen.groupBy("lang").agg(F.count("*").alias("s")), "lang")
    of_lang = spread.groupBy("lang").agg(F.sum("c").alias("kept"), F.sum(F.when(F.col("m") * HEAVY >= F.col("s"), F.col("c")).otherwise(0)).alias("n_heavy"))
    w = Window.partitionBy("lang")
    zero = F.lit(0).cast("long")
    whole = seen.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", *(F.coalesce(F.col(c), zero).alias(c) for c in ("total", "rows", "kept", "n_heavy")))
    out = whole.withColumns({"i": F.row_number().over(w.orderBy("source")) - 1, "s": F.count("*").over(w), "lang_total": F.sum("total").over(w)})
    base = F.coalesce(share(zero, F.col("total"), F.col("kept")), zero)
    return stored(out.withColumns({"base": base, "tiles": F.ceil(F.col("n_heavy") / F.least(F.greatest(F.col("s"), F.lit(LEAST_TILE)), F.lit(TILE))).cast("int")}).drop("n_heavy"), "divergence-groups")


def _tile(size: int):
    """What a tile's terms change: sums of absolute differences, less those of the absent shares, for the pairs of its two blocks of size sources."""

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        lang, a, b = key[0].as_py(), key[2].as_py(), key[3].as_py()
        i, p, absent = rows["i"].to_numpy(), rows["p"].to_numpy(), ~np.asarray(rows["term"].is_valid().to_numpy(), dtype=bool)
        line = rows["term"].combine_chunks().dictionary_encode()
        line = (line.combine_chunks() if isinstance(line, pa.ChunkedArray) else line).indices.fill_null(0).to_numpy()
        sources, at = np.unique(i, return_inverse=True)
        dense = np.empty((int(line[~absent].max(initial=-1)) + 1, len(sources)), np.int64)
        base = p[absent][np.argsort(i[absent])]
        dense[:] = base
        dense[line[~absent], at[~absent]] = p[~absent]
        left, right = np.flatnonzero(sources // size == a), np.flatnonzero(sources // size == b)
        ii, jj, dd = [], [], []
        for x in left:
            others = right[right > x]
            ii.append(np.full(len(others), sources[x]))
            jj.append(sources[others])
            dd.append(np.abs(dense[:, others] - dense[:, x : x + 1]).sum(0) - len(dense) * np.abs(base[others] - base[x]))
        ii, jj, dd = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (ii, jj, dd))
        return pa.table({"lang": pa.array([lang] * len(ii), pa.string()), "i": pa.array(ii, pa.int32()), "j": pa.array(jj, pa.int32()), "d": pa.array(dd, pa.int64())})

    return work


def _pair_corrections(batches):
    """Batches of lang and posts (i, p, base; sorted) of light terms to lang, i, j, d: what two sources that both have a term change."""
    langs: dict[str, int] = {}
    held: list[np.ndarray] = []
    n = 0

    def rows():
        keys = np.concatenate([h[0] for h in held])
        d = np.concatenate([h[1] for h in held])
        held.clear()
        pairs, at = np.unique(keys, axis=0, return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, at.ravel(), d)
        names = list(langs)
        return pa.RecordBatch.from_arrays([pa.array([names[k] for k in pairs[:, 0]], pa.string()), pa.array(pairs[:, 1], pa.int32()), pa.array(pairs[:, 2], pa.int32()), pa.array(total)], names=["lang", "i", "j", "d"])

    for batch in batches:
        posts = batch.column(1)
        ends, flat = posts.offsets.to_numpy(), posts.values
        i, p, base = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("i", "p", "base"))
        for k, lang in enumerate(batch.column(0).to_pylist()):
            x, y = np.triu_indices(ends[k + 1] - ends[k], 1)
            x, y = x + ends[k], y + ends[k]
            d = np.abs(p[x] - p[y]) - np.abs(p[x] - base[y]) - np.abs(base[x] - p[y]) + np.abs(base[x] - base[y])
            held.append((np.stack([np.full(len(x), langs.setdefault(lang, len(langs))), i[x], i[y]], axis=1), d))
            if (n := n + len(x)) > FLUSH_PAIRS:
                yield rows()
                n = 0
    if held:
        yield rows()


def distances(shares: DataFrame, group: DataFrame) -> DataFrame:
    """lang, i, j (i < j) and value, for all pairs of a language's sources. shares: the kept terms' lang, term, i, s, m, tiles, p, base."""
    kind = "lang string, i int, j int, d bigint"
    heavy = F.col("m") * HEAVY >= F.col("s")
    # Each posting goes to the tiles of its term and of all pairs of blocks with its source's; so does the share of an absent term.
    block, blocks = F.expr(f"i div {BLOCK}").cast("int"), F.ceil(F.col("s") / BLOCK).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, block).alias("a"), F.greatest(o, block).alias("b")))
    named = shares.filter(heavy).select("lang", F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int").alias("tile"), "s", "term", "i", "p")
    absent = group.filter("tiles > 0").select("lang", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "s", F.lit(None).cast("string").alias("term"), "i", F.col("base").alias("p"))
    cells = named.unionByName(absent).select("lang", "tile", F.explode(pairs).alias("o"), "term", "i", "p").select("lang", "tile", "o.a", "o.b", "term", "i", "p")
    dense = cells.groupBy("lang", "tile", "a", "b").applyInArrow(_tile(BLOCK), kind)
    light = shares.filter(~heavy)
    both = light.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("i", "p", "base"))).alias("posts")).filter(F.size("posts") > 1).select("lang", "posts").mapInArrow(tidy(_pair_corrections), kind)
    # What one source's light terms change: sums over its shares, up to each other source's absent share. All pairs are asked for, so all are listed here.
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    one = group.select("lang", "i", "base", "kept", (F.col("i") % SALTS).cast("int").alias("salt"))
    asked = one.join(group.select("lang", F.col("i").alias("j"), F.col("base").alias("x"), salt), ["lang", "salt"]).filter("i <> j")
    zero = F.lit(0).cast("long")
    has = light.groupBy("lang", "i", "p").agg(F.count("*").alias("c")).select("lang", "i", F.col("p").alias("x"), "c", F.lit(None).cast("int").alias("j"), zero.alias("base"), zero.alias("kept"))
    line = has.unionByName(asked.select("lang", "i", "x", zero.alias("c"), "j", "base", "kept"))
    w = Window.partitionBy("lang", "i")
    upto = w.orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    line = line.withColumns({"c0": F.sum("c").over(upto), "p0": F.sum(F.col("c") * F.col("x")).over(upto), "c1": F.sum("c").over(w), "p1": F.sum(F.col("c") * F.col("x")).over(w)}).filter("j IS NOT NULL")
    off = F.abs(F.col("base") - F.col("x"))
    differ = F.col("x") * (2 * F.col("c0") - F.col("c1")) + F.col("p1") - 2 * F.col("p0") - F.col("c1") * off
    single = line.select("lang", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), (differ + F.when(F.col("i") < F.col("j"), F.col("kept") * off).otherwise(0)).alias("d"))
    return dense.unionByName(both).unionByName(single).groupBy("lang", "i", "j").agg(F.sum("d").alias("value"))


def source_divergence(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has the distance to each other source, part ``term`` the terms more common than in the language."""
    found = postings(df, lang_col, source_col, text_col, min_docs)
    group = groups(df, found, lang_col, source_col)
    keys = ["lang", "source"]
    if group.count() <= BROADCAST_GROUPS:
        joined = found.join(F.broadcast(group), keys)
    else:
        joined = dealt_join(found, group, keys, hot_keys(group.filter("rows > 0"), keys, "rows"), ["term"])
    shares = stored(joined.select(*keys, "term", "i", "s", "m", "tiles", "base", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")), "divergence-shares")
    best = [F.col("value").desc(), F.col("item")]
    more = shares.filter("p > q").select(*keys, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int"))
    some = more.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(*best))).filter(F.col("rank") <= top).drop("rank", "salt")
    terms = some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).filter(F.col("rank") <= top)
    apart = distances(shares, group)
    both = apart.select("lang", F.explode(F.array(F.struct(F.col("i"), F.col("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("o"), "value").select("lang", "o.i", "o.j", "value")
    names = group.select("lang", "i", "source")
    pairs = both.join(names, ["lang", "i"]).join(names.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), ["lang", "j"])
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best)))
    return ranked.select(*keys, F.lit("pair").alias("part"), "item", "value", "rank").unionByName(terms.select(*keys, F.lit("term").alias("part"), "item", "value", "rank"))
