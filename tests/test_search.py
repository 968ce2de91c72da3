"""Index, ranking and planning against SQLite's FTS5 and small models."""

import random
import sqlite3

import pytest

from sparrowdex.functions.text import Porter, fold
from sparrowdex.operators import bm25 as B
from sparrowdex.plans import query as Q
from sparrowdex.plans import search as S

WORDS = "running runs policy policies relational multi factor token tokens connect connected caresses hopping hoping agreed generalization Étre ÀÉ".split()


def corpus(spark, n=40, seed=1):
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    rows = [(f"s{i % 3}/p{i}.md", f"s{i % 3}", text(3), text(r.randint(1, 30)), None) for i in range(n)]
    return spark.createDataFrame(rows, "path string, source string, title string, body string, url string"), rows


def fts(rows):
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE d USING fts5(title, path, body, key UNINDEXED, tokenize='porter unicode61')")
    c.executemany("INSERT INTO d VALUES (?, ?, ?, ?)", [(t, p, b, p) for p, _, t, b, _ in rows])
    return c


def ranks(df, leaves, weights):
    return {r.path: r.rank for r in B.ranked(B.build(df, True), leaves, {"body": (weights, B.FIELDS)}).collect()}


@pytest.mark.parametrize("terms", [["running"], ["policies", "token"], ["etre"], ["connect", "hop"]])
def test_bm25_equals_fts5(spark, terms):
    df, rows = corpus(spark)
    leaves = spark.createDataFrame([(0, "body", 0, i, i, [Porter.stem(t)], None) for i, t in enumerate(terms)], B.LEAF_SCHEMA)
    got = ranks(df, leaves, {"title": 5, "path": 3, "body": 1})
    want = dict(fts(rows).execute("SELECT key, bm25(d, 5, 3, 1) FROM d WHERE d MATCH ?", (" AND ".join(terms),)).fetchall())
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_phrase_equals_fts5(spark):
    df, rows = corpus(spark, 60, 3)
    leaves = spark.createDataFrame([(0, "body", 0, 0, 0, [Porter.stem("multi"), Porter.stem("factor")], None)], B.LEAF_SCHEMA)
    got = ranks(df, leaves, {"title": 1, "path": 1, "body": 1})
    want = dict(fts(rows).execute("SELECT key, bm25(d) FROM d WHERE d MATCH '\"multi factor\"'").fetchall())
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_porter_equals_fts5():
    words = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll".split()
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE d USING fts5(t, tokenize='porter unicode61')")
    c.executemany("INSERT INTO d VALUES (?)", [(w,) for w in words])
    c.execute("CREATE VIRTUAL TABLE v USING fts5vocab(d, 'row')")
    stems = {r[0] for r in c.execute("SELECT term FROM v")}
    assert {Porter.stem(fold(w)) for w in words} == stems


def test_plans():
    config = Q.Config(source_keywords={"acme": ("acme",), "blue cloud": ("bluecloud",)}, rewrites=((("explain",), ("query",), ("explain", "plan")),))
    assert Q.tokenize("How do I multi-factor_auth?") == ["how", "do", "i", "multi-factor_auth"]
    assert Q.without_stop_words(["how", "to"]) == ["how", "to"]
    assert Q.rewrite(["explain", "my", "query"], config) == ["explain", "plan"]
    assert Q.intended_sources(["blue", "cloud", "deploy"], config) == (["bluecloud"], ["deploy"])
    assert Q.strong_source(["acme", "sdk", "auth"], config) == "acme"
    assert Q.scoring_tokens("use the tool") == ["use", "tool"]
    leaves = Q.strict_leaves(["auth", "multi-factor"], config)
    assert (0, 0, ["oauth"]) in leaves and (0, 1, ["multi", "factor"]) in leaves
    assert any(x[2] == ["json", "web", "token"] for x in Q.surface_leaves(["jwt"], config))
    assert Q.relaxed_leaves(["a", "b"], config) == [] and Q.relaxed_leaves(["return", "a", "big", "payment"], config)


def test_exact_title_comes_first(spark):
    rows = [("s/a.md", "s", "token counting", "count tokens here", None), ("s/b/c/d.md", "s", "other", "token counting token counting token counting", None), ("s/e.md", "s", "unrelated", "nothing", None)]
    df = spark.createDataFrame(rows, "path string, source string, title string, body string, url string")
    hits = S.search(df, [(1, "token counting", None), (2, "nothing", None)]).orderBy("qid", "place").collect()
    assert [h.path for h in hits if h.qid == 1][0] == "s/a.md"
    assert [h.path for h in hits if h.qid == 2] == ["s/e.md"]
    assert all(isinstance(h.score, int) for h in hits)


def test_phrases_of_any_length_equal_fts5(spark):
    df, rows = corpus(spark, 50, 5)
    index, db, r = B.build(df, True), fts(rows), random.Random(2)
    asked = []
    for qid in range(24):
        words = fold(r.choice(rows)[3]).lower().split()
        at = r.randrange(len(words))
        asked.append((qid, words[at : at + r.randint(1, 5)]))
    asked += [(100, ["nowhere"]), (101, ["running", "nowhere"]), (102, ["token", "token"])]
    leaves = spark.createDataFrame([(q, "body", 0, 0, 0, [Porter.stem(t) for t in ts], None) for q, ts in asked], B.LEAF_SCHEMA)
    got = {(x.qid, x.path): x.rank for x in B.ranked(index, leaves, {"body": ({"title": 5, "path": 3, "body": 1}, B.FIELDS)}).collect()}
    want = {(q, p): k for q, ts in asked for p, k in db.execute("SELECT key, bm25(d, 5, 3, 1) FROM d WHERE d MATCH ?", ('"' + " ".join(ts) + '"',))}
    assert got.keys() == want.keys() and len(want) > 24 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_groups_and_branches_equal_fts5(spark):
    """All groups of a branch, any leaf of a group, any branch; and a source."""
    df, rows = corpus(spark, 60, 8)
    index, db = B.build(df, True), fts(rows)
    shapes = {
        1: ([(0, 0, "running"), (0, 1, "token"), (0, 1, "connect")], "running AND (token OR connect)"),
        2: ([(0, 0, "running"), (1, 0, "multi factor"), (2, 0, "etre")], "running OR \"multi factor\" OR etre"),
        3: ([(0, 0, "policy"), (0, 1, "nowhere"), (1, 0, "hop")], "(policy AND nowhere) OR hop"),
        4: ([(0, 0, "nowhere")], "nowhere"),
    }
    rows_ = [(q, "body", b, g, i, [Porter.stem(w) for w in t.split()], "s1" if q == 1 else None) for q, (leaves, _) in shapes.items() for i, (b, g, t) in enumerate(leaves)]
    got = {(x.qid, x.path): x.rank for x in B.ranked(index, spark.createDataFrame(rows_, B.LEAF_SCHEMA), {"body": ({"title": 1, "path": 1, "body": 1}, B.FIELDS)}).collect()}
    want = {(q, p): k for q, (_, match) in shapes.items() for p, k in db.execute("SELECT key, bm25(d) FROM d WHERE d MATCH ?", (match,)) if q != 1 or p.startswith("s1/")}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want if k[0] != 3)  # a leaf that occurs nowhere is no leaf there


def test_a_written_index_is_opened_again(spark, tmp_path):
    df, _ = corpus(spark)
    built = B.build(df, True, str(tmp_path / "index"))
    again = B.open_index(spark, str(tmp_path / "index"))
    assert again.stemmed and again.postings.count() == built.postings.count() > 0
    leaves = spark.createDataFrame([(0, "body", 0, 0, 0, ["run"], None)], B.LEAF_SCHEMA)
    tiers = {"body": ({"body": 1.0}, ("body",))}
    assert sorted(B.ranked(again, leaves, tiers).collect()) == sorted(B.ranked(built, leaves, tiers).collect())
