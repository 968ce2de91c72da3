"""The whole retrieval with stub embedder and ranker."""

from sparrowdex.plans.retrieval import Options, candidate_limit, pin_scope, prefers_latest, retrieve

ROWS = [
    ("a/tokens.md", "a", "token counting", "how to count tokens\nsame line tokens", None), ("a/other.md", "a", "other", "tokens tokens tokens\nsame line tokens", None), ("b__v1/tokens.md", "b__v1", "tokens old", "tokens of version one", None),
    ("c/evals/run.md", "c", "log", "tokens in a log", None), ("c/zebra.md", "c", "zebra", "stripes unbreakablewords", None),
]
Q = [(1, "tokens", None), (2, "breakable", None)]


def paths(df, qid=1):
    return [r.path for r in df.orderBy("place").collect() if r.qid == qid]


def test_planning():
    assert candidate_limit(10) == 50 and candidate_limit(10, 20) == 20 and candidate_limit(5, wide=True) == 200
    assert prefers_latest("the latest api") and not prefers_latest("api")
    assert pin_scope("/w/p/src", {"/w": "w", "/w/p": "p", "/w/pp": "no"}) == "p" and pin_scope("/x", {"/w": "w"}) is None


def test_modes_and_rules(spark):
    df = spark.createDataFrame(ROWS, "path string, source string, title string, body string, url string")
    assert set(paths(retrieve(df, Q))) == {"a/tokens.md", "a/other.md", "b__v1/tokens.md", "c/evals/run.md"}
    assert paths(retrieve(df, Q), 2) == [] and paths(retrieve(df, Q, options=Options(mode="auto")), 2) == ["c/zebra.md"]
    assert paths(retrieve(df, Q, options=Options(mode="scan")))[0] == "b__v1/tokens.md"
    assert "c/evals/run.md" not in paths(retrieve(df, Q, options=Options(hygiene=[("evals/", 20)])))
    assert "b__v1/tokens.md" not in paths(retrieve(df, Q, options=Options(latest_only=True)))
    assert set(paths(retrieve(df, Q, options=Options(profile=[("a", None)], strict_profile=True)))) == {"a/tokens.md", "a/other.md"}
    assert len(paths(retrieve(df, Q, options=Options(limit=2)))) == 2


def test_rerankers_and_vectors(spark):
    df = spark.createDataFrame(ROWS, "path string, source string, title string, body string, url string")
    before = paths(retrieve(df, Q))
    assert paths(retrieve(df, Q, options=Options(ranker=lambda q, p: [3, 99, 1])))[:2] == [before[2], before[0]]
    vectors = spark.createDataFrame([(p, [1.0, 0.0] if p == "c/zebra.md" else [0.0, 1.0]) for p, *_ in ROWS], "path string, embedding array<double>")
    got = retrieve(df, Q, options=Options(vectors=vectors, embedder=lambda t: [[1.0, 0.0]] * len(t)))
    assert "c/zebra.md" in paths(got) and paths(got, 2)[0] == "c/zebra.md"
    once = [s.text for r in retrieve(df, Q[:1], options=Options(once=True)).collect() for s in r.snippets]
    assert once.count("same line tokens") == 1
