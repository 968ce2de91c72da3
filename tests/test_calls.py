"""Model calls on the executors: limits, kinds of errors, budget, ledger, degrading."""

import time

from pyspark.sql import functions as F

from sparrowdex.operators import calls as C
from sparrowdex.operators import vectors as V
from sparrowdex.plans.retrieval import Options, retrieve
from sparrowdex.sources.discover import HttpError


def test_kinds_of_errors():
    waits, said = [], []

    def model(answers):
        left = iter(answers)

        def one(_):
            x = next(left)
            if isinstance(x, Exception):
                raise x
            return x

        return one

    go = lambda *answers, **k: C.ask("r", model(answers), C.Limits(wait=1, **k), waits.append)
    assert go(7) == (7, "answered", None, 1) and waits == []
    assert go(OSError("x"), HttpError(503), 7) == (7, "answered", None, 3) and waits == [1, 2]
    assert go(HttpError(429, 9.0), 7)[3] == 2 and waits[2:] == [9.0]
    for e, state, tries in ((HttpError(400), "refused", 1), (ValueError("v"), "refused", 1), (TimeoutError("t"), "failed", 3)):
        said = go(e, e, e)
        assert said[0] is None and said[1] == state and said[3] == tries and type(e).__name__ in said[2]
    assert go(HttpError(429, 100.0), 7)[1] == "late"  # the wait alone is longer than the request's time
    assert go(OSError("x"), tries=1)[1] == "failed"


def test_many_at_once_and_hanging_calls():
    began = time.time()
    got = C.ask_all(list(range(200)), lambda i: time.sleep(0.02) or i * 2, C.Limits(at_once=20))
    assert [r[0] for r in got] == [i * 2 for i in range(200)] and time.time() - began < 2
    began = time.time()
    got = C.ask_all(list(range(50)), lambda i: time.sleep(30 if i in (3, 9) else 0), C.Limits(at_once=4, seconds=0.3))
    assert {i for i, r in enumerate(got) if r[1] == "late"} == {3, 9} and time.time() - began < 5
    got = C.ask_all(list(range(50)), lambda i: time.sleep(30), C.Limits(at_once=4, seconds=0.2))
    assert [r[1:] for r in got][:1] == [("late", "no answer within 0.2 s", 1)] and {r[1] for r in got} == {"late"} and sum(r[3] for r in got) == 4
    assert C.ask_all([], lambda i: i, C.Limits()) == []


def test_budget_against_plain_sums(spark):
    import hashlib

    hot = [(7, 2)] * 900  # a third of all rows has one key
    rows = [(i if i % 50 else None, (i * 37) % 11) for i in range(2000)] + [(5, 3), (5, 3)] + hot
    df = spark.createDataFrame(rows, "k long, n long")
    digest = lambda k: hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()
    every = sum(n for _, n in rows)
    for budget in (0, 1, 10, 1000, 3000, 7000, every - 1, every, 10**9):
        got = C.within_budget(df.withColumn("r", F.lit("x")), "k", F.col("n"), budget).collect()
        by_hash = {}
        for k, n in rows:
            by_hash[digest(k)] = by_hash.get(digest(k), 0) + n
        total, sent = 0, {}
        for h in sorted(by_hash):
            total += by_hash[h]
            sent[h] = budget == 0 or total <= budget
        assert sorted(str((k, n, sent[digest(k)])) for k, n in rows) == sorted(str((r.k, r.prompt_tokens, r.sent)) for r in got)


def test_table_of_requests(spark):
    rows = [(i, None if i == 4 else f"text {i}") for i in range(10)] + [(None, "no key"), (2**60 + 1, "large key"), (7, "text 7")]
    df = spark.createDataFrame(rows, "k long, t string").withColumn("state", F.lit("clash"))

    def model(t):
        if t == "text 3":
            raise ValueError("no")
        return t.upper()

    done = C.call(df, "k", "t", model, "string", C.Limits(tasks=3), F.lit(5), len)
    got = sorted(((r.k, r.answer, r.state, r.tries, r.prompt_tokens, r.output_tokens) for r in done.collect()), key=str)
    assert len(got) == 13 and (4, None, "empty", 0, 0, 0) in got and (3, None, "refused", 1, 5, 0) in got
    assert (None, "NO KEY", "answered", 1, 5, 6) in got and (2**60 + 1, "LARGE KEY", "answered", 1, 5, 9) in got and got.count((7, "TEXT 7", "answered", 1, 5, 6)) == 2
    priced = V.usage_events(C.ledger(done, "p", "m", "rewrite"), spark.createDataFrame([("m", 1.0, 2.0)], "model string, input_per_million double, output_per_million double"), "now")
    sent = [r for r in got if r[3] > 0]
    assert priced.count() == len(sent) == 12
    assert abs(priced.agg(F.sum("cents")).first()[0] - sum(r[4] / 1e6 * 100 + r[5] * 2 / 1e6 * 100 for r in sent)) < 1e-12
    assert C.call(df.limit(0), "k", "t", model, "string").count() == 0


def test_ten_thousand_questions_and_a_failing_ranker(spark):
    """A slow ranker is asked by all tasks at once; questions that it fails for keep their order."""
    questions = spark.range(10_000).select(F.col("id").alias("qid"), F.concat(F.lit("question "), "id").alias("q"))
    hits = questions.select("qid", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("place")).withColumn("path", F.concat(F.lit("p"), F.col("place").cast("string"))).withColumn("score", F.lit(1))

    def ranker(q, paths):
        time.sleep(0.005)
        if q.endswith("7"):
            raise HttpError(400)
        return [3, 99, 3, 1]

    began = time.time()
    ranked, calls = C.rerank(hits, questions, ranker, C.Limits(at_once=32, tasks=4), depth=3)
    by_state = {r.state: r.n for r in calls.groupBy("state").agg(F.count("*").alias("n")).collect()}
    assert by_state == {"answered": 9000, "refused": 1000} and time.time() - began < 30  # 50 s one by one
    orders = {(r.failed, tuple(r.paths)): r.n for r in ranked.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths")).groupBy((F.col("qid") % 10 == 7).alias("failed"), "paths").agg(F.count("*").alias("n")).collect()}
    assert orders == {(False, ("p3", "p1", "p2", "p4")): 9000, (True, ("p1", "p2", "p3", "p4")): 1000}
    sure = questions.filter("qid < 10")
    assert C.rerank(hits.filter("qid < 20"), questions, ranker, sure=sure)[1].count() == 10


def test_retrieval_goes_on_without_its_models(spark):
    rows = [("a/tokens.md", "a", "token counting", "how to count tokens", None), ("a/other.md", "a", "other", "tokens tokens tokens", None), ("c/zebra.md", "c", "zebra", "stripes", None)]
    df = spark.createDataFrame(rows, "path string, source string, title string, body string, url string")
    vectors = spark.createDataFrame([(p, [1.0, 0.0] if p == "c/zebra.md" else [0.0, 1.0]) for p, *_ in rows], "path string, embedding array<double>")
    asked, paths = [(1, "tokens", None)], lambda got: [r.path for r in got.orderBy("place").collect()]

    def broken(*_):
        raise HttpError(401)

    plain = paths(retrieve(df, asked))
    assert paths(retrieve(df, asked, options=Options(ranker=broken))) == plain
    by_text = lambda texts: [[1.0, 0.0] if t == "animals" else [0.0, 1.0] for t in texts]
    near = lambda **k: retrieve(df, [(2, "unheard", None)], options=Options(vectors=vectors, embedder=by_text, **k))
    assert paths(near(rewriter=broken)) == paths(near()) and paths(near())[0] == "a/other.md" and paths(near(rewriter=lambda q: "animals"))[0] == "c/zebra.md"
