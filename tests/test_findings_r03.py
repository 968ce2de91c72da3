"""What the findings of round 3 named: copies of web addresses, memory of vector tiles, and what follows them."""

import duckdb
import pytest

from sparrowdex.queries import ORACLES, QUERIES


def same_as_sql(spark, folder, name, tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    rel = db.sql(ORACLES[name])
    want = rel.fetchall()
    rows = [tuple(r) for r in got.select(*rel.columns).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
    return rows


def test_hub_pages_of_repeated_urls(spark, tmp_path):
    urls = ["https://a.example/x/y", "https://a.example/x/y", "https://a.example/x", "https://A.example:8080/x/", "https://a.example//x//", "no url", None, "https://a.example", "https://a.example/a b/c"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("page_id", "url", "'<p>' html").write.parquet(f"{tmp_path}/pages.parquet")
    rows = same_as_sql(spark, tmp_path, "hub_pages", ["pages"])
    assert len(rows) == len(urls)


def test_tiles_of_vectors_hold_little(spark, tmp_path, monkeypatch):
    """All vector queries over tiles of a few rows, with copies, all-zero and missing vectors, and several blocks of queries."""
    import numpy as np
    import pyarrow as pa

    from sparrowdex.operators import vectors as V

    monkeypatch.setattr(V, "ROWS", 64)
    r = np.random.default_rng(1)
    base = r.normal(size=(40, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in base[i % 40 if i % 3 else 7]], i % 5) for i in range(900)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("vector_top_k", "vector_cosine", "vector_chunk_pool", "rank_fusion", "hybrid_candidates", "confidence_gate", "reranker_order"):
        assert same_as_sql(spark, tmp_path, name, ["embeddings"])
    sizes = []
    tile = V.TILE

    def seen(batches, qids, asked):
        for start, some, scores in tiles(batches, qids, asked):
            sizes.append(scores.size)
            yield start, some, scores

    tiles, batch = V._tiles, pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(3 * tile)]), pa.array([[1.0, float(i % 7)] for i in range(3 * tile)])], ["path", "embedding"])
    for _ in seen(iter([batch]), np.arange(2 * tile + 1), pa.array([[1.0, 2.0]] * (2 * tile) + [None])):
        pass
    assert max(sizes) <= tile * tile and len(sizes) == 9


@pytest.mark.parametrize("block", [1, 4, 4096])
def test_blocks_of_queries_with_odd_vectors(spark, block):
    from sparrowdex.operators import vectors as V

    v = spark.createDataFrame([("a/x", [1.0, 0.0]), ("a/y", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0]), ("e", [1.0, 1.0])], "path string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [2.0]), (4, [0.0, 1.0]), (5, [0.0, 0.0])], "qid long, embedding array<double>")
    got = {}
    for x in V.nearest(v, q, 2, block=block).collect():
        got.setdefault(x.qid, {})[x.place] = (x.path, x.score)
    half = round(0.5**0.5, 9)
    assert got == {1: {1: ("a/x", 0.995), 2: ("a/y", 0.995)}, 2: {1: ("b", 0.0), 2: ("c", 0.0)}, 3: {1: ("d", 1.0), 2: ("b", 0.0)}, 4: {1: ("e", half), 2: ("b", 0.0)}, 5: {1: ("b", 0.0), 2: ("c", 0.0)}}
    pages = {(x.qid, x.path): x.score for x in V.best_cosines(v.selectExpr("substring(path, 1, 1) path", "embedding"), q, block=block).collect()}
    assert len(pages) == 25 and pages[1, "a"] == 1.0 and pages[4, "a"] == 0.0 and pages[3, "d"] == 1.0


def test_license_scan_has_a_small_plan(spark):
    """The driver holds the plan of the last step, and not that of each match several times."""
    from sparrowdex.llm import licenses

    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b.py", "x = 1"), (3, "c.py", None)]
    got = licenses.license_scan(spark.createDataFrame(rows, "id long, path string, text string"))
    assert {r.id: (r.license, r.origin) for r in got.collect()} == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: (None, "none")}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") < 10


def test_postings_need_no_shuffle(spark):
    """A page's terms are counted in its row, one row a page and bucket; asked terms are broadcast to the postings."""
    from sparrowdex.operators import bm25 as B

    c = spark.createDataFrame([("s/a.md", "s", "red Fox", "red fox\nfox runs"), ("s/b.md", "s", None, None)], "path string, source string, title string, body string")
    pages = B.analyzed(c, False)
    got = B.postings_of(pages)
    assert {(r.path, r.term): (r.n_tokens, r.tf_title, r.tf_path, r.tf_body) for r in got.collect()} == {
        ("s/a.md", "red"): (9, 1, 0, 1), ("s/a.md", "fox"): (9, 1, 0, 2), ("s/a.md", "runs"): (9, 0, 0, 1), ("s/a.md", "s"): (9, 0, 1, 0), ("s/a.md", "a"): (9, 0, 1, 0), ("s/a.md", "md"): (9, 0, 1, 0),
        ("s/b.md", "s"): (3, 0, 1, 0), ("s/b.md", "b"): (3, 0, 1, 0), ("s/b.md", "md"): (3, 0, 1, 0),
    }
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.term, r.bucket) for r in B.clustered(pages).collect()} == {(r.term, r.b) for r in got.select("term", B.bucket_of(got.term).alias("b")).collect()}


def test_scan_remembers_few_words():
    from sparrowdex.plans import search as S

    t = S._Tokens(["a1", "7"])
    for i in range(40_000):
        t.of(f"a{i}")
    assert len(t.known) <= 32_768 and t.counts("a17 a17 b").tolist() == [2.0, 2.0]


def test_chunks_come_a_few_texts_at_a_time(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from sparrowdex.functions import text as T

    assert [len(s) for s in T.chunks(iter([pd.Series(["ab"] * 300)]), 1)] == [128, 128, 44]
    got = spark.range(0, 1000, 1, 1).select("id", T.text_chunks(F.col("id").cast("string"), 1).alias("c")).collect()
    assert all("".join(r.c) == str(r.id) for r in got) and len(got) == 1000
