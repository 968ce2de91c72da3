"""A stored positional index, and BM25 for many queries and tiers at once.

A query is a set of leaves (phrases of one or more terms), each in a group of a branch. A page matches where, for one
branch, every group has a leaf that occurs; its score sums over all leaves that occur. The index is written once:
postings (a row for each term of a page, with its frequency in each field) and pages (the terms of each field in order).

All queries and tiers share one plan. A phrase is looked for in the pages of its rarest term only, by their terms in
order. A branch of several groups starts from the pages of its rarest group, and only what these pages are asked for is
looked up; a query whose branches have one group each needs no look-up. So common words cost what they are asked for, and
not the length of their postings.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import stored
from ..functions.text import index_tokens, stems

K1, B = 1.2, 0.75
FIELDS = ("title", "path", "body")
LEAF_SCHEMA = "qid long, tier string, branch int, grp int, leaf int, terms array<string>, source string"


#: Postings that are clustered lie in so many buckets of terms.
BUCKETS = 32


@dataclass(frozen=True)
class Index:
    """postings: term, path, source, n_tokens, tf_title, tf_path, tf_body. pages: path, source, title, n_tokens, and
    terms_title, terms_path, terms_body. totals: one row, n_pages and avg_tokens.

    gone: path and gone_seq, where pages and postings have a seq and those of a path before its gone_seq don't count (see
    segments). bucketed: postings have their term's bucket as a partition column.
    """

    postings: DataFrame
    pages: DataFrame
    totals: DataFrame
    stemmed: bool
    gone: DataFrame | None = None
    bucketed: bool = False


def alive(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    """Of rows with path and seq those that count."""
    if gone is None:
        return rows
    return rows.join(gone, "path", "left").filter(F.col("gone_seq").isNull() | (F.col("gone_seq") <= F.col("seq"))).drop("gone_seq")


def tokens(corpus: DataFrame) -> DataFrame:
    """path, source, field, pos, term of every token of title, path and body."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), index_tokens(F.col(f)).alias("terms")) for f in FIELDS))
    return corpus.select("path", "source", F.explode(fields).alias("f")).select("path", "source", "f.field", F.posexplode("f.terms").alias("pos", "term"))


def analyzed(corpus: DataFrame, stemmed: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """The pages of a corpus (path, source, title, body) as an index holds them."""
    terms = {f"terms_{f}": stems(index_tokens(F.col(f))) if stemmed else index_tokens(F.col(f)) for f in FIELDS}
    size = sum(F.size(f"terms_{f}").cast("long") for f in FIELDS)
    return corpus.select("path", "source", "title", *(c.alias(n) for n, c in terms.items()), *keep).withColumn("n_tokens", size)


def _packed(pages: DataFrame) -> DataFrame:
    """bucket, path, source, n_tokens (seq) and terms with their frequencies by field: the postings of a page and bucket in one row.

    A page's terms are counted where the page is, so nothing is shuffled for them.
    """
    row = ["path", "source", "n_tokens", *(c for c in ("seq",) if c in pages.columns)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}

        def bucket(term: str) -> int:
            if len(known) >= 65_536:
                known.clear()
            found = known[term] = zlib.crc32(term.encode()) % BUCKETS
            return found

        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                some = batch.slice(start, 128)
                at, buckets, ends = [], [], [0]
                terms, tf = [], {f: [] for f in FIELDS}
                for i, fields in enumerate(zip(*(some.column(len(row) + j).to_pylist() for j in range(len(FIELDS))), strict=True)):
                    counts = [Counter(ts or ()) for ts in fields]
                    by: dict[int, list[str]] = defaultdict(list)
                    for t in counts[0].keys() | counts[1].keys() | counts[2].keys():
                        k = known.get(t)
                        by[bucket(t) if k is None else k].append(t)
                    for k, ts in by.items():
                        at.append(i)
                        buckets.append(k)
                        terms += ts
                        ends.append(len(terms))
                        for f, c in zip(FIELDS, counts, strict=True):
                            tf[f] += [c.get(t, 0) for t in ts]
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(terms, pa.string())), *(pa.ListArray.from_arrays(offsets, pa.array(tf[f], pa.int32())) for f in FIELDS)]
                own = [some.column(j).take(pa.array(at, pa.int64())) for j in range(len(row))]
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), *own, *lists], ["bucket", *row, "term", *(f"tf_{f}" for f in FIELDS)])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in row)
    return pages.select(*row, *(f"terms_{f}" for f in FIELDS)).mapInArrow(count, f"bucket int, {kinds}, term array<string>, " + ", ".join(f"tf_{f} array<int>" for f in FIELDS))


def _unpacked(packed: DataFrame) -> DataFrame:
    names = ["term", *(f"tf_{f}" for f in FIELDS)]
    each = packed.select(*(c for c in packed.columns if c not in names), F.explode(F.arrays_zip(*names)).alias("e"))
    rest = [c for c in packed.columns if c not in names and c != "bucket"]
    return each.select("e.term", *rest, *(f"e.tf_{f}" for f in FIELDS), "bucket")


def postings_of(pages: DataFrame) -> DataFrame:
    """term, path, source, n_tokens and the frequency in each field (and seq, where pages have it)."""
    return _unpacked(_packed(pages)).drop("bucket")


def bucket_of(term: Column) -> Column:
    return (F.crc32(term) % BUCKETS).cast("int")


def clustered(pages: DataFrame) -> DataFrame:
    """The postings of pages with their bucket, each bucket's rows together in as many tasks as their size asks for, in order of terms.

    A page's postings of a bucket go to it as one row.
    """
    return _unpacked(_packed(pages).hint("rebalance", "bucket")).sortWithinPartitions("bucket", "term")


def build(corpus: DataFrame, stemmed: bool = False, folder: str | None = None) -> Index:
    """The index of a corpus (path, source, title, body), written to folder, or to the shared folder of the session."""
    spark = corpus.sparkSession

    def written(df: DataFrame, what: str) -> DataFrame:
        if folder is None:
            return stored(df, f"index-{what}")
        df.write.parquet(f"{folder}/{what}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{what}")

    pages = written(analyzed(corpus, stemmed), "pages")
    # A page's terms are counted where the page is; sorted postings let a scan skip what is not asked for.
    postings = written(postings_of(pages).sortWithinPartitions("term"), "postings")
    totals = written(pages.agg(F.count("*").cast("double").alias("n_pages"), F.avg("n_tokens").alias("avg_tokens"), F.lit(stemmed).alias("stemmed")), "totals")
    return Index(postings, pages, totals, stemmed)


def open_index(spark: SparkSession, folder: str) -> Index:
    """An index that build() wrote to folder."""
    postings, pages, totals = (spark.read.parquet(f"{folder}/{x}") for x in ("postings", "pages", "totals"))
    return Index(postings, pages, totals, totals.first()["stemmed"])


#: So many rows of a key and a number are broadcast; larger tables are joined by shuffles.
FEW = 500_000


def _small(df: DataFrame, what: str) -> DataFrame:
    """df, written; to be broadcast if it has FEW rows at most."""
    out = stored(df, what)
    return F.broadcast(out) if out.count() <= FEW else out


def _phrase_hits(index: Index, phrases: DataFrame) -> DataFrame:
    """phrase (terms), path, source, n_tokens and tf by field of every phrase that occurs; phrases: phrase, n; a small table."""
    postings = index.postings
    if index.bucketed:
        # At most BUCKETS numbers: the scan reads the buckets of the terms that are asked for, and no other.
        asked = [r[0] for r in phrases.select(F.explode("phrase").alias("term")).select(bucket_of(F.col("term"))).distinct().collect()]
        postings = postings.filter(F.col("bucket").isin(asked))
    single = phrases.filter("n = 1").select("phrase", F.get("phrase", F.lit(0)).alias("term"))
    cols = ["phrase", "path", "source", "n_tokens", *(f"tf_{f}" for f in FIELDS)]
    found = alive(postings.join(F.broadcast(single), "term"), index.gone).select(*cols)
    longer = phrases.filter("n > 1")
    if longer.isEmpty():
        return found
    several = longer.select("phrase", F.explode("phrase").alias("term")).distinct()
    common = postings.join(F.broadcast(several.select("term").distinct()), "term").groupBy("term").agg(F.count("*").alias("df"))
    rarest = several.join(common, "term", "left").groupBy("phrase").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    at = ["path", *(["seq"] if index.gone is not None else [])]
    maybe = _small(alive(postings.join(F.broadcast(rarest), "term"), index.gone).select("phrase", *at), "phrase-pages")

    def times(terms: Column) -> Column:
        m = F.size("phrase")
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(terms) - m + 1, F.lit(1))), lambda i: (F.get(terms, i - 1) == F.get("phrase", F.lit(0))) & (F.slice(terms, i, m) == F.col("phrase")))
        return F.when(F.size(terms) >= m, F.size(at)).otherwise(0)

    read = index.pages.select(*at, "source", "n_tokens", *(f"terms_{f}" for f in FIELDS)).join(maybe, at)
    read = read.select("phrase", "path", "source", "n_tokens", *(times(F.col(f"terms_{f}")).alias(f"tf_{f}") for f in FIELDS))
    return found.unionByName(read.filter(F.greatest(*(f"tf_{f}" for f in FIELDS)) > 0))


def ranked(index: Index, leaves: DataFrame, tiers: dict[str, tuple[dict[str, float], tuple[str, ...]]]) -> DataFrame:
    """qid, tier, path, source, rank (negative: smaller is better) of every page that matches its query in a tier.

    leaves: LEAF_SCHEMA, terms as the index has them. tiers: the weights by field and the fields that count. A leaf's
    document frequency counts pages of all sources within the fields; a leaf in over half of all pages weighs next to
    nothing. Leaves are planned on the driver: they, and what is as small, are broadcast, postings are not shuffled for them.
    """
    asked = leaves.filter(F.size("terms") > 0)
    # Hits have a phrase's number in place of its words.
    numbers = stored(asked.select("terms").distinct().withColumn("phrase", F.row_number().over(Window.orderBy("terms"))), "phrases")
    asked = asked.join(F.broadcast(numbers), "terms")
    found = _phrase_hits(index, numbers.select(F.col("terms").alias("phrase"), F.size("terms").alias("n"))).withColumnRenamed("phrase", "terms")
    hits = stored(found.join(F.broadcast(numbers), "terms").drop("terms"), "phrase-hits")
    sets = list(dict.fromkeys(fields for _, fields in tiers.values()))
    within = lambda fields: F.greatest(F.lit(0), F.lit(0), *(f"tf_{f}" for f in fields)) > 0
    by_tier = lambda value: F.coalesce(*(F.when(F.col("tier") == t, value(w, fields)) for t, (w, fields) in tiers.items()))
    common = hits.groupBy("phrase").agg(*(F.count_if(within(s)).alias(f"df{i}") for i, s in enumerate(sets)))
    df = by_tier(lambda _, fields: F.col(f"df{sets.index(fields)}"))
    shape = asked.join(common, "phrase", "left").select("qid", "tier", "branch", "grp", "phrase", F.col("source").alias("only"), F.coalesce(df, F.lit(0)).alias("df"))
    need = Window.partitionBy("qid", "tier", "branch")
    groups = shape.groupBy("qid", "tier", "branch", "grp").agg(F.sum("df").alias("pages"))
    groups = groups.withColumns({"need": F.count("*").over(need), "rare": F.row_number().over(need.orderBy("pages", "grp"))})
    groups = groups.withColumn("alone", F.max("need").over(Window.partitionBy("qid", "tier")) == 1)
    # One small table: the leaves with what their groups need.
    plan = stored(shape.join(groups.drop("pages"), ["qid", "tier", "branch", "grp"]), "leaf-plan")
    fits = by_tier(lambda _, fields: within(fields)) & (F.col("only").isNull() | (F.col("only") == F.col("source")))
    leaf = plan.filter("df > 0").groupBy("qid", "tier", "phrase").agg(F.first("only").alias("only"), F.first("df").alias("df"), F.first("alone").alias("alone"))

    weight = by_tier(lambda w, _: sum(F.lit(float(w.get(f, 0))) * F.col(f"tf_{f}") for f in FIELDS))
    idf = F.greatest(F.log((F.col("n_pages") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))

    def scored(rows: DataFrame) -> DataFrame:
        # totals is a single row
        parts = rows.filter(fits).withColumn("f", weight).crossJoin(F.broadcast(index.totals.select("n_pages", "avg_tokens")))
        part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_tokens") / F.col("avg_tokens")))
        return parts.select("qid", "tier", "phrase", "path", "source", part.alias("part"))

    direct = scored(hits.join(F.broadcast(leaf.filter("alone").drop("alone")), "phrase"))
    first = plan.filter("NOT alone AND rare = 1 AND df > 0").select("qid", "tier", "branch", "phrase", "only")
    start = hits.join(F.broadcast(first), "phrase").filter(fits)
    start = start.select("qid", "tier", "path").distinct()
    wanted = start.join(F.broadcast(leaf.filter("NOT alone").drop("alone")), ["qid", "tier"])
    looked = stored(scored(wanted.join(hits, ["phrase", "path"])), "looked-up")
    have = looked.select("qid", "tier", "phrase", "path").join(F.broadcast(plan.select("qid", "tier", "branch", "grp", "phrase", "need")), ["qid", "tier", "phrase"])
    full = have.groupBy("qid", "tier", "branch", "path", "need").agg(F.count_distinct("grp").alias("have")).filter("have = need").select("qid", "tier", "path").distinct()
    matched = looked.join(full, ["qid", "tier", "path"])
    return direct.unionByName(matched.select(*direct.columns)).groupBy("qid", "tier", "path", "source").agg((-F.sum("part")).alias("rank"))


def top(ranked: DataFrame, limit: int, by: tuple[str, ...] = ("qid", "tier")) -> DataFrame:
    """The best `limit` of each query (all if 0), place in `place`; ties by path, segment by segment."""
    order = Window.partitionBy(*by).orderBy(F.round("rank", 9), F.split("path", "/"))
    placed = ranked.withColumn("place", F.row_number().over(order))
    return placed.filter(F.col("place") <= limit) if limit > 0 else placed
