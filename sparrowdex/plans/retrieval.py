"""The whole retrieval: limits, back end, fusion, rerankers, version and hygiene rules, output, for all questions at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import stored
from ..functions.text import dedupe_snippets
from ..operators import policy as P
from ..operators import vectors as V
from ..operators.calls import Limits, call, rerank
from . import query
from .search import scan, search

LATEST_WORDS = ("latest", "newest", "current", "recent")


def candidate_limit(limit: int, rerank: int = 0, wide: bool = False) -> int:
    """How many candidates a search needs: for a reranker its own number, else what hygiene fetches over; more where wide."""
    n = max(limit, rerank) if rerank else max(limit, P.over_fetch(limit))
    return max(n, 20 * limit + 100) if wide else n


def prefers_latest(q: str) -> bool:
    return any(t in LATEST_WORDS for t in query.tokenize(q))


def pin_scope(cwd: str, roots: dict[str, str]) -> str | None:
    """The scope of the longest root (root -> scope) that cwd lies in."""
    fits = [r for r in roots if cwd == r.rstrip("/") or cwd.startswith(r.rstrip("/") + "/")]
    return roots[max(fits, key=len)] if fits else None


@dataclass
class Options:
    """What a caller asks for; every step without its option is left out."""

    limit: int = 10
    mode: str = "index"  # index, scan, or auto: index, and scan for questions that it has no hit for
    exact: bool = False
    profile: list[tuple[str, str | None]] = field(default_factory=list)
    strict_profile: bool = False
    vectors: DataFrame | None = None  # path, embedding
    embedder: Callable[[list[str]], list[list[float]]] | None = None
    rewriter: Callable[[str], str] | None = None  # of the text that is embedded
    ranker: Callable[[str, list[str]], list[int]] | None = None  # places (from 1) of the best paths
    rank_depth: int = 20
    calls: Limits | None = None  # of the ranker and the rewriter, which run on the executors
    confidence: float = 0.0  # a lead that needs no reranker
    hygiene: list[tuple[str, int]] = field(default_factory=list)
    latest_only: bool = False
    version: str | None = None  # only hits of this version, or `latest`
    registry: DataFrame | None = None  # family, latest_version, lts_version: turns the version policy on
    pins: DataFrame | None = None  # family, scope, version
    cwd: str = ""
    roots: dict[str, str] = field(default_factory=dict)  # of projects: root -> scope
    snippets: bool = True
    most_snippets: int = 0  # 0: 3, or what compact has
    snippet_size: int = 0  # 0: 160 bytes, or what compact has
    compact: bool = False  # one snippet of 80 bytes where nothing else is asked for
    once: bool = False  # each snippet once a question


    def shape(self) -> tuple[int, int]:
        """How many snippets, and how long."""
        few = (1, 80) if self.compact else (3, 160)
        return self.most_snippets or few[0], self.snippet_size or few[1]


def _ranked(hits: DataFrame, options: Options, questions: DataFrame) -> DataFrame:
    """hits by an injected ranker, asked on the executors; sure questions, and those without an answer, are left alone."""
    held = stored(hits, "ranked-hits")
    sure = V.confident(held, options.confidence).filter("confident") if options.confidence > 0 else None
    return rerank(held, questions, options.ranker, options.calls, options.rank_depth, sure)[0]


def _embedded(questions: DataFrame, o: Options) -> DataFrame:
    """qid, embedding of the questions, rewritten first where a rewriter answers; what the embedder refuses is left out."""
    texts = questions.select("qid", F.col("q").alias("text"))
    if o.rewriter:
        said = call(questions, "qid", "q", o.rewriter, "string", o.calls).filter("state = 'answered'")
        texts = texts.join(said.select("qid", "answer"), "qid", "left").select("qid", F.coalesce("answer", "text").alias("text"))
    got = V.embed(texts.select(F.col("qid").cast("string").alias("path"), "text"), o.embedder)
    return stored(got.select(F.col("path").cast("long").alias("qid"), "embedding"), "question-vectors")


def _searched(pages: DataFrame, questions: list[tuple[int, str, str | None]], families: dict[int, str], config: query.Config | None, limit: int, o: Options) -> DataFrame:
    """search(); a question about a family asks each of its sources, and keeps a page's best score."""
    if not families:
        return search(pages, questions, config, limit, o.exact, most=o.shape()[0], size=o.shape()[1])
    version = P.version_of(F.col("source"))
    wanted = pages.select("source").distinct().withColumn("family", version["family"])
    sources: dict[str, list[str]] = {}
    for r in wanted.filter(F.col("family").isin(sorted(set(families.values())))).toLocalIterator():
        sources.setdefault(r.family, []).append(r.source)
    asked, of = [], {}
    for qid, text, source in questions:
        for s in sorted(sources.get(families[qid], [])) if qid in families else [source]:
            of[len(asked)] = qid
            asked.append((len(asked), text, s))
    each = search(pages, asked, config, limit, o.exact, most=o.shape()[0], size=o.shape()[1]).withColumnRenamed("qid", "ask")
    named = each.join(pages.sparkSession.createDataFrame(sorted(of.items()), "ask long, qid long"), "ask")
    best = named.groupBy("qid", "path").agg(F.max_by(F.struct("source", "title", "score", "snippets"), F.struct("score", -F.col("ask"))).alias("h")).select("qid", "path", "h.*")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "path")))


def _with_versions(hits: DataFrame, o: Options, questions: list[tuple[int, str, str | None]], families: dict[int, str]) -> DataFrame:
    """hits with family, version, lane, pinned_here and prefers; only those of the family and version that are asked for."""
    spark = hits.sparkSession
    pins = o.pins if o.pins is not None else spark.createDataFrame([], "family string, scope string, version string")
    rows = [(q, o.version == "latest" or o.latest_only or prefers_latest(t), families.get(q)) for q, t, _ in questions]
    asked = spark.createDataFrame(rows, "qid long, prefers boolean, wanted string")
    h = P.version_info(hits, pins, o.registry, pin_scope(o.cwd, o.roots)).join(asked, "qid")
    h = h.filter(F.col("wanted").isNull() | (F.col("family") == F.col("wanted"))).drop("wanted")
    if o.version == "latest" or o.latest_only:
        return h.filter("lane = 'latest'")
    return h.filter(F.col("version").eqNullSafe(F.lit(o.version.lstrip("v")))) if o.version else h


def _by_version(hits: DataFrame, o: Options, questions: list[tuple[int, str, str | None]], families: dict[int, str]) -> DataFrame:
    """hits with their lane's points added to their score, in the order of the sums."""
    h = _with_versions(hits, o, questions, families)
    h = h.withColumn("score", F.col("score") + P.lane_score(F.col("lane"), F.col("prefers"), F.col("pinned_here")))
    return h.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "path"))).select(*hits.columns)


def _one_of_equivalents(hits: DataFrame, o: Options, questions: list[tuple[int, str, str | None]], families: dict[int, str]) -> DataFrame:
    """After the rerankers: hits of the wanted versions, in their order, the first of pages that differ by version only."""
    h = _with_versions(hits, o, questions, families)
    inner = F.regexp_replace(F.regexp_replace("path", "^[^/]*/", ""), r"(^|/)(v\d+(\.\d+)*|\d+\.\d+(\.\d+)*)(?=/)", "$1")
    return P.collapse_versions(h, F.concat_ws("/", "family", inner)).drop("place").withColumnRenamed("new_place", "place").select(*hits.columns)


def retrieve(corpus: DataFrame, questions: list[tuple[int, str, str | None]], config: query.Config | None = None, options: Options | None = None) -> DataFrame:
    """qid, place, path, source, title, score, snippets of the best pages of each question (qid, text, source or None)."""
    o = options or Options()
    spark = corpus.sparkSession
    pages = P.profile_match(corpus, o.profile) if o.profile else corpus
    if o.strict_profile and o.profile:
        pages = pages.filter("in_profile")
    wide = candidate_limit(o.limit, o.rank_depth if o.ranker else 0, o.registry is not None)
    families: dict[int, str] = {}
    if o.registry is not None:
        known = {r[0] for r in o.registry.select("family").collect()}  # a deployment's list
        families = {q: family for q, _, s in questions if (family := P.family_of(s, known)[1])}
    asked = spark.createDataFrame([(q, t) for q, t, _ in questions], "qid long, q string")
    none = F.array().cast("array<struct<line:int,text:string>>")

    def scanned(of: DataFrame) -> DataFrame:
        got = scan(pages, of, wide).join(pages.select("path", "source", "title"), "path")
        return got.select("qid", F.col("place").cast("int").alias("place"), "path", "source", "title", F.col("score").cast("int").alias("score"), none.alias("snippets"))

    if o.mode == "scan":
        hits = scanned(asked)
    else:
        hits = _searched(pages, questions, families, config, wide, o).select("qid", F.col("place").cast("int").alias("place"), "path", "source", "title", F.col("score").cast("int").alias("score"), "snippets")
        if o.mode == "auto":
            hits = hits.unionByName(scanned(asked.join(hits.select("qid"), "qid", "left_anti")))
    if o.registry is not None:
        hits = _by_version(hits, o, questions, families)
    if o.vectors is not None and o.embedder is not None:
        near = V.nearest(o.vectors, _embedded(asked, o), wide)
        union = V.hybrid_candidates(hits, near).select("qid", "path", "place")
        fused = V.fuse(union, near).select("qid", "path", "place")
        info = pages.select("path", "source", "title")
        scores = hits.select("qid", "path", "score", "snippets")
        hits = fused.join(info, "path").join(scores, ["qid", "path"], "left").select("qid", "place", "path", "source", "title", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("snippets", none).alias("snippets"))
    if o.ranker:
        hits = _ranked(hits, o, asked)
    if o.registry is not None:
        hits = _one_of_equivalents(hits, o, questions, families)
    elif o.latest_only:
        version = P.version_of(F.col("source"))
        hits = hits.filter(version["lane"] == "latest")
    renumber = F.row_number().over(Window.partitionBy("qid").orderBy("place"))
    if o.hygiene:
        marked = hits.withColumn("penalty", P.hygiene_penalty(F.col("path"), F.lit(None).cast("string"), o.hygiene))
        hits = P.apply_hygiene(marked, o.limit).drop("place", "penalty").withColumnRenamed("new_place", "place")
    else:
        hits = hits.withColumn("place", renumber)
        hits = hits.filter(F.col("place") <= o.limit) if o.limit > 0 else hits
    if not o.snippets:
        hits = hits.withColumn("snippets", none)
    elif o.once:
        hits = hits.drop("snippets").join(dedupe_snippets(hits).select("qid", "path", "snippets"), ["qid", "path"])
    return hits.select("qid", "place", "path", "source", "title", "score", "snippets")
