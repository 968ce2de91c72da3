"""The relaxed body tier: some words of a question, in bodies of the source that is given or strongly meant."""

import sqlite3

from sparrowdex.plans import query as Q
from sparrowdex.plans import search as S

STUB = "This article has multiple variants. Fetch one of the following URLs: rotate signing certificate nightly"
ROWS = [
    ("acme/p1.md", "acme", "one", "rotate the certificate of a service " * 3), ("acme/p2.md", "acme", "two", "signing is done nightly by rotate and certificate"), ("acme/p3.md", "acme", "three", "a certificate " + "filler " * 40),
    ("acme/p4.md", "acme", "four", STUB), ("acme/p5.md", "acme", "five", "nothing of it"), ("other/p6.md", "other", "six", "rotate signing certificate elsewhere"), *((f"other/f{i}.md", "other", "fill", "plain words here") for i in range(12)),
]
WORDS = ["rotate", "signing", "certificate", "nightly", "quickly"]


def found(spark, q, source, config=None):
    df = spark.createDataFrame([(*r, None) for r in ROWS], "path string, source string, title string, body string, url string")
    hits = S.search(df, [(1, q, source)], config).orderBy("place").collect()
    return [(h.path, h.score) for h in hits]


def fts_ranks():
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE d USING fts5(title, path, body, key UNINDEXED, source UNINDEXED, tokenize='porter unicode61')")
    c.executemany("INSERT INTO d VALUES (?, ?, ?, ?, ?)", [(t, p, b, p, s) for p, s, t, b in ROWS])
    rows = c.execute("SELECT key, bm25(d) FROM d WHERE d MATCH ? AND source = 'acme' AND instr(lower(body), ?) = 0 ORDER BY 2", (" OR ".join(WORDS), S.VARIANT_STUB)).fetchall()
    return [(k, int(round(-r * 10, 9))) for k, r in rows]


def want():
    """Tier scores, and the best of them divided by the place."""
    ranks = fts_ranks()
    return [(k, s + ranks[0][1] // i) for i, (k, s) in enumerate(ranks, 1)]


def test_given_source(spark):
    assert len(want()) == 3
    assert found(spark, " ".join(WORDS), "acme") == want()


def test_strong_source(spark):
    config = Q.Config(source_keywords={"acme": ("acme",)})
    got = found(spark, "acme " + " ".join(WORDS), None, config)
    assert {p for p, _ in got} == {k for k, _ in want()}


def test_no_source(spark):
    assert found(spark, " ".join(WORDS), None) == []
    assert "relaxed_body" not in Q.plan(1, " ".join(WORDS)).leaves
