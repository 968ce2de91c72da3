"""Fetching, crawls, versions of a corpus, vectors, evaluation reports, version policy on small inputs."""

import json
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparrowdex.functions import text as T
from sparrowdex.operators import evaluation as EV
from sparrowdex.operators import manifest as M
from sparrowdex.operators import policy as P
from sparrowdex.operators import urls as U
from sparrowdex.operators import vectors as V
from sparrowdex.plans.retrieval import Options, retrieve
from sparrowdex.sources import discover as D


@pytest.mark.parametrize("size", [4, 5, 6, 7, 8, 9, 160])
def test_cuts_count_bytes(spark, size):
    r = random.Random(size)
    texts = ["", "a", "€" * 100, "é" * 80, "ab€𝄞é"] + ["".join(r.choice("aé€𝄞") for _ in range(r.randint(0, 120))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.first_bytes(F.col("t"), size).alias("a"), T.cut(F.col("t"), size).alias("b"))
    for t, a, b in df.collect():
        raw = t.encode()
        assert a == raw[:size].decode(errors="ignore")
        assert b == (t if len(raw) <= size else raw[: size - 3].decode(errors="ignore") + "...") and len(b.encode()) <= size


def test_fetch_rules(spark, tmp_path):
    log = tmp_path / "log"

    def fetcher(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        n = open(log).read().split().count(url)
        if url == "gone":
            raise D.HttpError(404)
        if url == "busy" and n < 3:
            raise D.HttpError(429, 7)
        if url == "down":
            raise D.HttpError(503)
        if url == "reset" and n < 2:
            raise OSError("reset")
        return "body of " + url

    def sleep(seconds):
        with open(tmp_path / "waits", "a") as f:
            f.write(f"{seconds}\n")

    urls = spark.createDataFrame([(u,) for u in ("ok", "gone", "busy", "down", "reset")], "url string").coalesce(1)
    got = {r.url: (r.body, r.error) for r in D.fetch(urls, fetcher, sleep=sleep).collect()}
    assert got == {"ok": ("body of ok", None), "gone": (None, "HTTP 404"), "busy": ("body of busy", None), "down": (None, "HTTP 503"), "reset": ("body of reset", None)}
    tried = open(log).read().split()
    assert [tried.count(u) for u in ("ok", "gone", "busy", "down", "reset")] == [1, 1, 3, 3, 2]
    assert open(tmp_path / "waits").read().split() == ["7", "7", "0.5", "1.0", "0.5"]


def test_deep_sitemaps_are_no_silent_end(spark):
    web = {f"m{i}": f"<sitemapindex><sitemap><loc>m{i + 1}</loc></sitemap></sitemapindex>" for i in range(9)} | {"m9": "<urlset><url><loc>http://x/1</loc></url></urlset>", "loop": "<sitemapindex><sitemap><loc>loop</loc></sitemap><sitemap><loc>m9</loc></sitemap></sitemapindex>"}
    with pytest.raises(ValueError, match="deeper than 5"):
        D.sitemap_urls(spark, "m0", web.__getitem__)
    assert [r.url for r in D.sitemap_urls(spark, "m0", web.__getitem__, 12).collect()] == ["http://x/1"]
    assert [r.url for r in D.sitemap_urls(spark, "loop", web.__getitem__).collect()] == ["http://x/1"]


def test_crawl_documents(spark):
    web = {"/d/a": ["/d/b", "/d/c", "/other"], "/d/b": ["/d/a", "/d/e", "/d/gone"], "/d/c": ["/d/e"], "/d/e": []}

    def fetcher(url):
        if url not in web:
            raise D.HttpError(404)
        return json.dumps(web[url])

    got = [(r.path, r.depth) for r in D.crawl_documents(spark, "/d/a", fetcher, json.loads, "/d/").collect()]
    assert got == [("/d/a", 0), ("/d/b", 1), ("/d/c", 1), ("/d/e", 2)]
    assert len(D.crawl_documents(spark, "/d/a", fetcher, json.loads, "/d/", limit=2).collect()) == 2


def test_vectors_are_checked(spark, tmp_path):
    schema = "path string, model string, chunk_idx int, dim int, embedding array<double>"
    old = spark.createDataFrame([("p", "m", 0, 2, [1.0, 0.0]), ("p", "m", 1, 2, [0.0, 1.0]), ("q", "m", 0, 2, [1.0, 1.0]), ("q", "other", 0, 3, [1.0] * 3)], schema)
    fresh = spark.createDataFrame([("p", "m", 0, 2, [5.0, 5.0])], schema)
    got = {(r.path, r.model, r.chunk_idx): list(r.embedding) for r in V.upsert_vectors(old, fresh, True).collect()}
    assert got == {("p", "m", 0): [5.0, 5.0], ("q", "m", 0): [1.0, 1.0], ("q", "other", 0): [1.0] * 3}
    for row in (("x", "m", 0, 2, [1.0]), ("x", "m", 0, 3, [1.0] * 3), ("x", "m", 0, 2, None), ("x", "m", 0, 0, [])):
        with pytest.raises(PySparkException, match="vector of"):
            V.upsert_vectors(old, spark.createDataFrame([row], schema), True).collect()
    about = V.write_flat(old.filter("chunk_idx = 0"), "m", str(tmp_path / "flat")).first()
    assert (about.model, about.dim, about.n) == ("m", 2, 2)
    assert [r.path for r in spark.read.parquet(str(tmp_path / "flat/vectors")).collect()] == ["p", "q"]


def test_chunks_to_embed(spark):
    pages = spark.createDataFrame([("same", 1, "m", "T", "a" * 30), ("newer", 2, "m", "", "b" * 30), ("new", 1, "m", "T", "c" * 8), ("recut", 1, "m", "T", "d" * 8)], "path string, mtime_ns long, model string, title string, body string")
    cache = spark.createDataFrame([("same", 1, "m", i, 10) for i in range(3)] + [("newer", 1, "m", i, 10) for i in range(3)] + [("recut", 1, "m", 0, 99)], "path string, mtime_ns long, model string, chunk_idx int, chunk_size int")
    got = {(r.path, r.chunk_idx): r.text for r in V.chunks_to_embed(pages, 10, cache).collect()}
    assert got == {("newer", i): "b" * 10 for i in range(3)} | {("new", 0): "T\n\n" + "c" * 8, ("recut", 0): "T\n\n" + "d" * 8}


def test_cosines_against_the_expression(spark):
    r = random.Random(1)
    v = spark.createDataFrame([(i, [r.random() for _ in range(4 if i % 5 else 3)]) for i in range(40)] + [(99, [0.0] * 4)], "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 20 = 0 OR vec_id = 7").selectExpr("vec_id AS qid", "embedding")
    want = {(x.qid, x.vec_id): x.s for x in v.crossJoin(q.withColumnRenamed("embedding", "e")).select("qid", "vec_id", V.cosine(F.col("embedding"), F.col("e")).alias("s")).collect()}
    got = {(x.qid, x.vec_id): x.score for x in V.cosines(v, q, block=2).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_order_statistics(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.choice([None, *range(20)])) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v int")
    for by, groups in ((("g",), "ab"), ((), [None])):
        got = {(x.g if by else None): (x.p50, x.p99) for x in EV.order_statistics(df, "v", {"p50": 0.5, "p99": 0.99}, by).collect()}
        for g in groups:
            values = sorted(v for k, v in rows if v is not None and g in (None, k))
            assert got[g] == (values[int((len(values) - 1) * 0.5)], values[int((len(values) - 1) * 0.99)])


def test_reports(spark, tmp_path):
    questions = spark.createDataFrame([(1, ["s/a"]), (2, ["t/b"]), (3, ["t/c"])], "qid long, expect array<string>")
    hits = spark.createDataFrame([(1, "s/a", 1), (2, "x", 1), (2, "t/b", 2)], "qid long, path string, place int")
    cases = EV.cases(questions, hits, F.lit(10)).join(questions, "qid").withColumns({"expected_source": F.lit(""), "source": F.lit(None).cast("string"), "query_type": F.when(F.col("qid") == 1, "lexical"), "latency_ms": F.col("qid") * 1.5})
    named = EV.named(cases)
    assert [(r.name, r.n, r.hit_1, r.p95_ms) for r in EV.overview(named, "library").orderBy("place").collect()] == [("t", 2, 0.0, 3.0), ("s", 1, 1.0, 1.5)]
    assert [r.name for r in EV.overview(named, "type").orderBy("place").collect()] == ["lexical", "unknown"]
    for _ in range(2):
        EV.write_report(named, str(tmp_path), "2024-01-01T00:00:00Z")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/report").collect())
    assert text.startswith("# Evaluation\n\n| n |") and "## By library" in text and text.endswith("## Misses\n\n- 3")
    assert spark.read.json(f"{tmp_path}/log").count() == 2 and spark.read.json(f"{tmp_path}/cases").count() == 3


def test_the_guard_counts_what_was_there(spark):
    old = spark.range(40).select(F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("p"), "id").alias("path"))
    new = spark.range(10, 200).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("x").alias("path"), F.lit(False).alias("skipped"))
    assert tuple(M.deletion_guard(M.replace_manifest(old, new)).first()) == (40, 10, False)
    assert M.rebuild_or_upsert(None, 0, 5) == M.rebuild_or_upsert(old, 4, 5) == "rebuild" and M.rebuild_or_upsert(old, 1, 5) == "upsert"


def test_index_lines(spark, tmp_path):
    c = spark.createDataFrame([("s/b.md", "s", "b.md", "B", None), ("s/x/a.md", "s", "x/a.md", "A", "http://a"), ("s/x/0.md", "s", "x/0.md", "Z", ""), ("t/a.md", "t", "a.md", "A", None)], "path string, source string, rel string, title string, url string")
    M.write_lines(M.source_index(c), "grp", "rel", str(tmp_path / "index"))
    text = {r.source: r.t for r in spark.read.text(str(tmp_path / "index"), wholetext=True).withColumn("f", F.input_file_name()).groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("f", "value"))), lambda x: x["value"]), "").alias("t")).collect()}
    assert text["s"] == "- [B](b.md)\n\n## x\n\n- [Z](x/0.md)\n- [A](x/a.md)\n" and text["t"] == "- [A](a.md)\n"
    assert {r.line for r in M.llms_txt(c).collect()} == {"- [B](s/b.md)", "- [A](http://a)", "- [Z](s/x/0.md)", "- [A](t/a.md)"}


def test_status(spark):
    pages = spark.createDataFrame([("a", "x.md", "text"), ("b", "x.md", "text"), ("c", "x.md", "text")], "source string, rel string, body string")
    rows = [("a", "p", "2024-01-01T00:00:00Z"), ("a", "p", "2024-01-02T00:00:00Z"), ("b", "p", "no time")]
    got = [(r.source, r.missing_fresh, r.age_hours, r.n_same) for r in M.staleness(pages, spark.createDataFrame(rows, "source string, path string, fetched_at string"), "2024-01-05T00:00:00Z", 24).orderBy("place").collect()]
    assert got == [("b", True, 0, 0), ("c", True, 0, 0), ("a", False, 72, 1)]
    row = M.index_match(spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("b",), ("z",)], "path string")).first()
    assert (row.n_missing, row.n_gone, row.matches) == (1, 1, False)


def test_pins_and_orphans(spark):
    assert spark.range(1).select(*(P.is_pinned(F.lit(v)) for v in ("1.2.3", "v2", "^1.0", "workspace:*", "1.x", "", ">=1"))).first() == (True, True, False, False, False, False, False)
    orphan = spark.createDataFrame([("f", "1", "s"), ("g", "2", "s")], "family string, version string, scope string")
    marked = spark.createDataFrame([("f", "1", "s", "2024-01-01T00:00:00Z")], "family string, version string, scope string, since string")
    got = {r.family: (r.since, r.gone) for r in P.kept_orphans(orphan, marked, "2024-03-01T00:00:00Z").collect()}
    assert got == {"f": ("2024-01-01T00:00:00Z", True), "g": ("2024-03-01T00:00:00Z", False)}
    plan = P.seed_plan(orphan, spark.createDataFrame([("f__v1",), ("f",)], "source string"))
    assert {r.source: r.action for r in plan.collect()} == {"f__v1": "keep", "g__v2": "seed"}
    assert P.family_of("f__v1", {"f"}) == ("f__v1", None) and P.family_of("f", {"f"}) == (None, "f") and P.family_of(None, {"f"}) == (None, None)


def test_routes_of_any_size(spark):
    urls = spark.createDataFrame([("http://a/docs/x",), ("http://b/",)], "url string")
    routes = spark.createDataFrame([(0, "a", "/docs/", "s1"), (1, "a", "/", "s2"), (2, "b", "/", "s3")], "idx int, host string, prefix string, source string")
    assert {tuple(r) for r in U.route(urls, routes).collect()} == {("http://a/docs/x", "s1", "x.md"), ("http://b/", "s3", "index.md")}


def test_version_policy_in_retrieval(spark):
    rows = [("lib/guide.md", "lib", "guide", "latest tokens here"), ("lib__v1/guide.md", "lib__v1", "guide", "latest tokens here"), ("lib__v2/guide.md", "lib__v2", "guide", "latest tokens here"), ("lib__v2/only.md", "lib__v2", "only", "latest tokens tokens"), ("misc/x.md", "misc", "x", "latest tokens tokens tokens tokens")]
    df = spark.createDataFrame([(*r, None) for r in rows], "path string, source string, title string, body string, url string")
    registry = spark.createDataFrame([("lib", "3", "2")], "family string, latest_version string, lts_version string")
    pins = spark.createDataFrame([("lib", "proj", "1")], "family string, scope string, version string")

    def paths(q="tokens", source=None, **options):
        return [r.path for r in retrieve(df, [(1, q, source)], options=Options(registry=registry, pins=pins, **options)).orderBy("place").collect()]

    # In general what is pinned goes before the latest, lts and what has no version; pages that differ by version only are one.
    assert paths()[0] == "lib__v1/guide.md" and set(paths()) == {"lib__v1/guide.md", "lib__v2/only.md", "misc/x.md"}
    assert paths("latest tokens")[0] == "lib/guide.md"
    # In a project its own pin goes first.
    pins = spark.createDataFrame([("lib", "proj", "2")], "family string, scope string, version string")
    assert paths(cwd="/w/p/src", roots={"/w/p": "proj"})[0].startswith("lib__v2/")
    # A family asks all its sources; a pinned source, a version and the latest narrow it.
    assert set(paths(source="lib")) == {"lib__v2/guide.md", "lib__v2/only.md"} or set(paths(source="lib")) == {"lib__v1/guide.md", "lib__v2/only.md"}
    assert paths(source="lib__v1") == ["lib__v1/guide.md"]
    assert set(paths(version="2")) == {"lib__v2/guide.md", "lib__v2/only.md"} and paths(version="latest") == ["lib/guide.md"]


def test_usage_and_ages(spark):
    from sparrowdex.operators import telemetry as TL

    calls = spark.createDataFrame([("p", "m", "", 0, 2_000_000, None), ("p", "m", "rank", 1_000_000, 9, 500_000), ("p", "free", "x", 5, 5, 5)], "provider string, model string, call_site string, prompt_tokens long, total_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m", 0.02, 0.1)], "model string, input_per_million double, output_per_million double")
    got = [(r.call_site, r.tokens, round(r.cents, 6)) for r in V.usage_events(calls, prices, "2024-01-01T00:00:00Z").orderBy("call_site").collect()]
    assert got == [("embed", 2_000_000, 4.0), ("rank", 1_000_000, 7.0), ("x", 5, 0.0)]
    row = spark.range(1).select(TL.age_hours(F.lit("2024-01-01T10:30:00Z"), "2024-01-03T00:00:00Z"), TL.age_hours(F.lit("x"), "2024-01-03T00:00:00Z"), TL.within_days(F.lit("2024-01-01T10:30:00Z"), "2024-01-03T00:00:00Z", 1)).first()
    assert tuple(row) == (37, None, False)


def test_snippets_as_asked(spark):
    body = "\n".join(f"tokens line {i} " + "x" * 200 for i in range(6))
    df = spark.createDataFrame([("s/a.md", "s", "a", body, None)], "path string, source string, title string, body string, url string")

    def got(**options):
        return [(s.line, len(s.text)) for r in retrieve(df, [(1, "tokens", None)], options=Options(**options)).collect() for s in r.snippets]

    assert got() == [(1, 160), (2, 160), (3, 160)] and got(compact=True) == [(1, 80)] and got(compact=True, most_snippets=2, snippet_size=50) == [(1, 50), (2, 50)] and got(snippets=False) == []
