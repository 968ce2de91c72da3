"""Source mixing, the tolerant as-of join and the source divergence audit, against their SQL and plain versions."""

import datetime
import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sparrowdex.llm import asof, divergence, mixing
from sparrowdex.llm.queries import ORACLES, QUERIES

WORDS = [f"w{i}" for i in range(60)]


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def same_as_sql(spark, folder, name):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    cols = sorted(got.columns)
    rel = c.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    rows = [tuple(r) for r in got.select(*cols).collect()]
    want = [tuple(r[rel.columns.index(x)] for x in cols) for r in rel.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
    return got


def mixed_rows(seed, n=1500):
    rng = random.Random(seed)
    sources = [None, "", "a", "b", "é", "empty", "one", "tiny"]
    rows = []
    for i in range(n):
        source = rng.choices(sources, [2, 2, 30, 8, 8, 3, 0, 1])[0]
        k = rng.choice([0, 1, 3, 12, 80]) if source != "empty" else 0
        text = None if rng.random() < 0.03 else " \t" + "\n".join(rng.choices(WORDS, k=k)) + " "
        rows.append((None if rng.random() < 0.03 else i, text, rng.choice(["x", "y", None, ""]), source, 0))
    return [*rows, *rows[:40], (9_000, " ".join(WORDS * 500), "x", "one", 0), (9_001, "", "z", "lonely", 0), (9_002, None, None, "lonely", 0)]


@pytest.mark.parametrize("few, refine, broadcast", [(256, 10, True), (256, 2, False), (8, 10, True)])
def test_mix(spark, tmp_path, monkeypatch, few, refine, broadcast):
    monkeypatch.setattr(mixing, "REFINE", few)
    monkeypatch.setattr(mixing, "STEP", refine)
    if not broadcast:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    rows = mixed_rows(few)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = mixing.mix(docs, keep=("lang", "source")).collect()
    assert len(got) == len(rows)
    by: dict = {}
    for r in got:
        assert r.taken == r.size * r.copies and r.copies in (0, 1, 2)
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    assert abs(sum(rs[0].target for rs in by.values()) - 1.5 * total) < 1e-3
    for rs in by.values():
        assert sum(r.size for r in rs) == rs[0].source_size and rs[0].target <= 2 * rs[0].source_size
        least = min((r.size for r in rs if r.size), default=0)
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(least, 80 if len(rs) < 20 else 12) or len(rs) < 3
    again = mixing.mix(docs.repartition(7), keep=("lang", "source")).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mix_by_sql(spark, tmp_path):
    same_as_sql(spark, documents(spark, tmp_path, mixed_rows(1)), "op11_source_mix")


def test_targets_by_rounds(spark):
    rng = random.Random(5)
    sizes = [(f"s{i:03}", rng.choice([0, 1, 5, 1000, 10**12])) for i in range(70)] + [(None, 3)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([(s, n, 1) for s, n in sizes], "source string, source_size long, n_docs long")).collect()}
    weight = {s: (5, 2, 1)[k % 3] for k, (s, _) in enumerate(sizes)}
    left, open_, want = 1.5 * sum(n for _, n in sizes), dict(sizes), {}
    while True:
        w = sum(weight[s] for s in open_)
        full = [s for s, n in open_.items() if left / w * weight[s] > 2 * n]
        if not full:
            break
        for s in full:
            want[s] = 2.0 * open_[s]
        left = 1.5 * sum(n for _, n in sizes) - sum(want.values())
        open_ = {s: n for s, n in open_.items() if s not in want}
    want |= {s: left / w * weight[s] for s in open_}
    assert got == pytest.approx(want)


def test_mix_of_nothing_and_names(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix(empty).collect() == []
    odd = spark.createDataFrame([(1, "a b", None, 5, 6), (2, None, None, 7, 8)], "doc_id bigint, text string, source string, h long, base long")
    assert sorted((r.doc_id, r.taken, r.h, r.base) for r in mixing.mix(odd, keep=("h", "base")).collect()) == [(1, 2, 5, 6), (2, 0, 7, 8)]
    with pytest.raises(ValueError):
        mixing.mix(odd.withColumn("size", F.lit(1)), keep=("size",))
    with pytest.raises(ValueError):
        mixing.mix(odd, share=(5, 2))


def shop(spark, folder, seed, n=900):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)

    def when():
        return None if rng.random() < 0.03 else start + datetime.timedelta(microseconds=rng.randrange(60 * 24 * 3_600_000_000)) if rng.random() < 0.5 else start + datetime.timedelta(hours=6 * rng.randrange(200))

    def client():
        return rng.choice([7, 7, 7, None, *range(12)])

    clicks = [(i, when(), client()) for i in range(n)]
    clicks += [*clicks[:50], (3, None, 4), (4, start, 2), (None, start + datetime.timedelta(days=9), 7), (None, None, 7)]
    sales = [(i, client(), when(), rng.choice([None, 1.005, 2.0, 2.0, 77.125, float("nan"), 1e300])) for i in range(n // 2)]
    sales += [*sales[:20], (None, 7, start + datetime.timedelta(days=8), 9.0)]
    spark.createDataFrame(clicks, "click_id long, ts timestamp_ntz, client_id long").write.parquet(f"{folder}/clicks.parquet")
    spark.createDataFrame(sales, "sale_id long, client_id long, sold_at timestamp_ntz, total double").write.parquet(f"{folder}/sales.parquet")
    return str(folder)


@pytest.mark.parametrize("partitions, block, zone", [(1, 1024, "UTC"), (23, 2, "America/New_York"), (200, 3, "UTC")])
def test_asof(spark, tmp_path, monkeypatch, partitions, block, zone):
    monkeypatch.setattr(asof, "BLOCK", block)
    folder = shop(spark, tmp_path, partitions)
    before = spark.conf.get("spark.sql.session.timeZone")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        same_as_sql(spark, folder, "op12_asof_orders")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_asof_of_one_moment_without_tolerance(spark):
    left = spark.createDataFrame([(i, "k", 5) for i in range(300)] + [(900, "z", 1), (901, None, 1)], "id long, key string, t long")
    right = spark.createDataFrame([("k", 5, i % 4, "x") for i in range(40)] + [("k", 6, 9, "y"), (None, 0, 1, "x")], "key string, t long, a int, b string")
    rows = asof.asof_join(left, right, None, ["a", "b"], 16).collect()
    assert len(rows) == 302
    assert {(r.match_t, r.a, r.b, r.n_tied) for r in rows if r.key == "k"} == {(5, 3, "x", 40)}
    assert {(r.match_t, r.n_tied) for r in rows if r.key != "k"} == {(None, 0)}
    assert {r.n_tied for r in asof.asof_join(left, right.limit(0), 3, ["a"], 4).collect()} == {0}
    assert asof.asof_join(left.limit(0), right, 3, ["a"], 4).collect() == []
    with pytest.raises(ValueError):
        asof.asof_join(left, right.withColumnRenamed("a", "part"), 3, ["part"])


def audit_rows(seed, n=1300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", None, "", *(f"s{k}" for k in range(14))])
        own = [f"Own{source}É{k}" for k in range(2)] * (rng.random() < 0.6)
        some = [f"pair{k}-x" for k in range(9) if source in (f"s{k}", f"s{k + 1}", "a")]
        text = None if rng.random() < 0.02 else " ".join(rng.choices(WORDS[:20], k=rng.randrange(12)) + own + some) + rng.choice(["", "…Ünïcode, THE the\x7f"])
        rows.append((i, text, rng.choice(["x", "x", "y", None]), source, 0))
    return [*rows, *rows[:30], (1, "rare words", "only", "q", 0), (2, None, "only", "r", 0), (3, "", "x", "silent", 0)]


@pytest.mark.parametrize("heavy, tile, block, broadcast", [(4, 512, 256, True), (4, 3, 4, False), (0, 512, 256, True), (10**6, 2, 3, True), (2, 5, 1, True)])
def test_divergence(spark, tmp_path, monkeypatch, heavy, tile, block, broadcast):
    for k, v in (("HEAVY", heavy), ("LEAST_TILE", 2), ("TILE", tile), ("BLOCK", block)):
        monkeypatch.setattr(divergence, k, v)
    if not broadcast:
        monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 1)
    got = same_as_sql(spark, documents(spark, tmp_path, audit_rows(heavy + tile)), "op13_source_divergence")
    assert {r.part for r in got.select("part").distinct().collect()} == {"pair", "term"}


def test_divergence_of_little(spark):
    kind = "doc_id bigint, text string, lang string, source string, item string, rank int"
    assert divergence.source_divergence(spark.createDataFrame([], kind)).collect() == []
    rows = divergence.source_divergence(spark.createDataFrame([(1, "a", None, "p", "x", 1), (1, None, "", None, "x", 1)], kind)).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in rows) == [("", "", "pair", "p", 0, 1), ("", "p", "pair", "", 0, 1)]


def test_terms_of_long_texts():
    text = ("Ab é0x" * 400_000).encode()
    counted: Counter = Counter()
    for part in divergence._terms(text):
        assert len(part) < 400_000
        counted.update(part)
    assert counted == Counter(text.decode().replace("Ab", "ab").replace("0", " ").encode().split())
    assert [len(p) for p in divergence._terms(b"x" * (3 << 20))] == [1]


def test_shares_by_long_division(spark):
    rows = [(0, 0, 1), (10**12, 9 * 10**14, 10**9), (123_456_789_012, 123_456_789_013, 7), (5, 5, 0)]
    got = spark.createDataFrame(rows, "n long, total long, kept long").select(divergence.share(F.col("n"), F.col("total"), F.col("kept")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 5) // (t + 5 * k) for n, t, k in rows]
