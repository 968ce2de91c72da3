"""Search: plans, tiers, re-ranking, snippets, for a table of questions in one dataflow."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import snippets
from ..operators.bm25 import FIELDS, LEAF_SCHEMA, Index, alive, build, ranked, top
from ..operators.rank import merge, rerank
from . import query

#: Fixed values, by tier: the weights of title, path and body as the index applies them and as they are meant, the fields, and the limit as a multiple of the caller's and an addend.
TIERS = {
    "title": ({"title": 0, "path": 1, "body": 1}, {"title": 1}, ("title",), 2, 5),
    "path": ({"title": 0, "path": 1, "body": 1}, {"path": 1}, ("path",), 8, 30),
    "body": ({"title": 1, "path": 1, "body": 1}, {"title": 5, "path": 3, "body": 1}, FIELDS, 5, 10),
    "strong": ({"title": 1, "path": 1, "body": 1}, {"title": 5, "path": 3, "body": 1}, FIELDS, 5, 10),
    "relaxed": ({"title": 0, "path": 1, "body": 1}, {"title": 5, "path": 3}, ("title", "path"), 10, 25),
    "relaxed_body": ({"title": 1, "path": 1, "body": 1}, {"title": 5, "path": 3, "body": 1}, FIELDS, 10, 25),
}
#: Pages with this in the body only name their variants, and are no hits of relaxed_body.
VARIANT_STUB = "this article has multiple variants. fetch one of the following urls"
PLAN_SCHEMA = "qid long, q string, scoring array<string>, synonymed array<string>, concepts array<array<string>>, intended array<string>, source_words array<string>, strong string"


def search(corpus: DataFrame, questions: list[tuple[int, str, str | None]], config: query.Config | None = None, limit: int = 10, exact: bool = False, stemmed: bool = True, weights: str = "effective", index: Index | None = None, most: int = 3, size: int = 160) -> DataFrame:
    """qid, place, path, source, title, score, snippets for questions (qid, text, source or None).

    weights: `effective` or `documented` (see TIERS). index: that of the corpus, if it is built already. most, size: of the
    snippets. Bodies are joined to final hits only.
    """
    spark = corpus.sparkSession
    config = config or query.Config()
    index = index or build(corpus, stemmed)
    plans = [query.plan(qid, q, source, config, exact) for qid, q, source in questions]
    rows = query.leaf_rows(plans)
    if index.stemmed:
        from ..functions.text import _stem

        rows = [(*r[:5], [_stem(t) for t in r[5]], r[6]) for r in rows]
    found = ranked(index, spark.createDataFrame(rows, LEAF_SCHEMA), {t: (effective if weights == "effective" else documented, fields) for t, (effective, documented, fields, _, _) in TIERS.items()})
    if any(r[1] == "relaxed_body" for r in rows):
        stubs = corpus.filter(F.contains(F.lower("body"), F.lit(VARIANT_STUB))).select("path", F.lit("relaxed_body").alias("tier"))
        found = found.join(stubs, ["path", "tier"], "left_anti")
    best = top(found, 0)
    hits = best.filter(F.col("place") <= F.coalesce(*(F.when(F.col("tier") == t, times * limit + more) for t, (*_, times, more) in TIERS.items())))
    words = lambda p: sorted({w for s in p.intended for k, names in config.source_keywords.items() if s in names for w in query.tokenize(k)})
    known = spark.createDataFrame([(p.qid, p.text, p.scoring, p.synonymed, p.concepts, p.intended, words(p), p.strong) for p in plans], PLAN_SCHEMA)
    profile = [c for c in ("in_profile", "in_profile_sub") if c in corpus.columns]
    facts = alive(index.pages, index.gone).select("path", "title")
    if profile:
        facts = facts.join(corpus.select("path", *profile), "path")
    final = rerank(merge(hits), known.drop("q"), facts, limit, config.boosts, tuple(max(0, p) for p in config.profile_points))
    return final.join(corpus.select("path", "body"), "path").join(known.select("qid", "q"), "qid").select("qid", "place", "path", "source", "title", "score", snippets(F.col("body"), F.col("q"), most, size).alias("snippets"))


#: White space as the questions are split by it.
_SPACE = re.compile("[ \t\n\x0b\f\r]+")


class _Tokens:
    """Which tokens occur in a word, and how often: looked up by one automaton, remembered for some thousand words, whatever a table has."""

    def __init__(self, tokens: list[str]):
        import ahocorasick

        self.tokens, self.known = tokens, {}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t, i)
        if tokens:
            self.automaton.make_automaton()

    def of(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        if (found := self.known.get(word)) is None:
            if len(self.known) >= 32_768:
                self.known.clear()
            at = sorted({i for _, i in self.automaton.iter(word)}) if self.tokens else []
            found = self.known[word] = np.array(at, dtype=np.int64), np.array([word.count(self.tokens[i]) for i in at], dtype=float)
        return found

    def counts(self, text: str) -> np.ndarray:
        """How often each token occurs in text; a token has no white space, so it lies in one word."""
        words = Counter(w for w in _SPACE.split(text) if w)
        found = [self.of(w) for w in words]
        n = np.repeat(np.fromiter(words.values(), dtype=float, count=len(words)), [len(i) for i, _ in found])
        at, times = (np.concatenate(x) if found else np.zeros(0) for x in (list(zip(*found, strict=True)) or [[], []]))
        return np.bincount(at.astype(np.int64), weights=times * n, minlength=len(self.tokens))


def scan(corpus: DataFrame, questions: DataFrame, limit: int = 10, block: int = 1000) -> DataFrame:
    """The search without an index: every body is read once for each block of questions (qid, q).

    5 points for a token in the title, and one for each occurrence of each token in the body, tokens of a question
    counted as often as it has them. Each batch of pages keeps only its own best of every question before anything is
    shuffled. limit 0: all pages with points.
    """
    spark = corpus.sparkSession
    pages = corpus.select("path", F.lower("title").alias("title"), F.lower("body").alias("body"))
    asked = questions.select("qid", F.filter(F.split(F.lower("q"), r"\s+"), lambda x: x != "").alias("tokens"))

    def search_block(rows: list[tuple[int, list[str]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(rows)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids = np.array([q for q, _ in shared.value], dtype=np.int64)
            words = sorted({t for _, ts in shared.value for t in ts})
            at, tokens = {t: i for i, t in enumerate(words)}, _Tokens(words)
            times = np.zeros((len(qids), len(words)))
            for i, (_, ts) in enumerate(shared.value):
                for t in ts:
                    times[i, at[t]] += 1
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    some = batch.slice(start, 256)
                    path, titles, bodies = (some.column(j) for j in range(3))
                    bodies, titles = (np.stack([tokens.counts(t or "") for t in c.to_pylist()], axis=1) for c in (bodies, titles))
                    scores = times @ bodies + 5 * ((times @ (titles > 0)) > 0)
                    n = some.num_rows if limit <= 0 else min(limit, some.num_rows)
                    floor = np.maximum(1.0, np.partition(scores, some.num_rows - n, axis=1)[:, some.num_rows - n])
                    q, own = np.nonzero(scores >= floor[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(qids[q]), path.take(pa.array(own)), pa.array(scores[q, own].astype(np.int64))], ["qid", "path", "score"])

        return pages.mapInArrow(best, "qid long, path string, score long")

    parts, held = [], []
    for q, ts in asked.toLocalIterator():
        held.append((q, list(ts)))
        if len(held) >= block:
            parts.append(search_block(held))
            held = []
    if held or not parts:
        parts.append(search_block(held))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    placed = found.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "path")))
    return placed.filter(F.col("place") <= limit) if limit > 0 else placed


def questions_of(benchmark: DataFrame) -> list[tuple[int, str, str | None]]:
    """The benchmark's items as questions, in order of item_id; runs of white space are one blank."""
    got = benchmark.select("item_id", F.regexp_replace(F.trim("text"), r"\s+", " ").alias("q")).orderBy("item_id")
    return [(r[0], r[1], None) for r in got.toLocalIterator()]
