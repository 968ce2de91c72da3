"""Index segments and commits: upserts against rebuilds, versions, conflicts, what breaks off, merging and vacuum."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from sparrowdex.operators import bm25 as B
from sparrowdex.operators import segments as SG
from sparrowdex.streaming import commits

SCHEMA = "path string, source string, title string, body string"
WORDS = [f"w{i}" for i in range(30)]


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(B, "BUCKETS", 3)


def page(rng, k):
    return (f"s{k % 3}/{k}.md", f"s{k % 3}", " ".join(rng.choices(WORDS, k=2)), " ".join(rng.choices(WORDS, [40 - i for i in range(30)], k=rng.randrange(25))))


def searched(spark, index):
    leaves = [(q, "body", 0, i, i, [w], None) for q, ws in enumerate((["w0", "w3"], ["w7"], ["w29"], ["w1", "w2", "w4"])) for i, w in enumerate(ws)]
    leaves += [(9, "body", 0, 0, 0, ["w0", "w1"], None), (10, "body", 0, 0, 0, ["w2", "w0", "w0"], None), (11, "body", 0, 0, 0, ["w5"], "s1")]
    rows = B.ranked(index, spark.createDataFrame(leaves, B.LEAF_SCHEMA), {"body": ({"title": 5, "path": 3, "body": 1}, B.FIELDS)}).collect()
    return sorted((r.qid, r.path, r.source, round(r.rank, 9)) for r in rows)


def frame(spark, pages):
    return spark.createDataFrame(list(pages.values()), SCHEMA)


@pytest.mark.parametrize("stemmed", [False, True])
def test_upserts_equal_a_rebuild(spark, tmp_path, stemmed, monkeypatch):
    monkeypatch.setattr(SG, "FANOUT", 2)
    rng, folder = random.Random(stemmed), str(tmp_path / "index")
    pages = {k: page(rng, k) for k in range(60)}
    SG.build(frame(spark, pages), folder, stemmed)
    for step in range(3):
        fresh = {k: page(rng, k) for k in rng.sample(range(80), 5)}
        lost = rng.sample(sorted(pages), 4) if step else []
        pages |= fresh
        for k in lost:
            pages.pop(k)
        removed = spark.createDataFrame([(f"s{k % 3}/{k}.md",) for k in lost] + [("no/such.md",), (None,)], "path string")
        # A page that is both fresh and removed is fresh.
        pages |= {k: fresh[k] for k in lost if k in fresh}
        got = SG.apply(spark, folder, frame(spark, fresh), removed)
    want = B.build(frame(spark, pages), stemmed)
    assert searched(spark, got.index) == searched(spark, want)
    assert got.state["n_pages"] == len(pages) and got.index.totals.first()["avg_tokens"] == pytest.approx(want.totals.first()["avg_tokens"])
    assert len(got.state["segments"]) < 5
    SG.merge(spark, folder, everything=True)
    last = SG.opened(spark, folder)
    assert len(last.state["segments"]) == 1 and last.state["gone"] == [] and searched(spark, last.index) == searched(spark, want)


def test_readers_stay_on_their_version(spark, tmp_path):
    rng, folder = random.Random(3), str(tmp_path / "index")
    pages = {k: page(rng, k) for k in range(20)}
    assert SG.opened(spark, folder) is None
    with pytest.raises(ValueError):
        SG.apply(spark, folder, frame(spark, pages))
    reader = SG.build(frame(spark, pages), folder)
    before = searched(spark, reader.index)
    SG.apply(spark, folder, frame(spark, {0: page(rng, 0), 21: page(rng, 21)}))
    newest = SG.build(frame(spark, {1: pages[1]}), folder)
    assert searched(spark, reader.index) == before != searched(spark, newest.index)
    assert SG.reopened(spark, reader).number == newest.number and SG.reopened(spark, newest) is newest
    assert searched(spark, SG.opened(spark, folder, reader.number).index) == before
    # Pinned and recent versions stay, the one between goes, and so does what nobody committed.
    os.makedirs(f"{folder}/data/left-behind/pages")
    assert SG.vacuum(spark, folder, keep=1, pinned=[reader.number]) == []
    with pytest.raises(ValueError):
        SG.opened(spark, folder, 1)
    gone = SG.vacuum(spark, folder, keep=1, pinned=[reader.number], older=-1)
    assert "left-behind" in gone and len(gone) == 3
    assert searched(spark, reader.index) == before
    assert len(SG.vacuum(spark, folder, keep=1, older=-1)) == 1 and searched(spark, SG.opened(spark, folder).index) == searched(spark, newest.index)


def test_what_breaks_off_is_nobodys(spark, tmp_path, monkeypatch):
    rng, folder = random.Random(4), str(tmp_path / "index")
    held = SG.build(frame(spark, {k: page(rng, k) for k in range(9)}), folder)

    def stop(*_):
        raise OSError("the writer is lost")

    monkeypatch.setattr(commits, "commit", stop)
    for work in (lambda: SG.build(frame(spark, {0: page(rng, 0)}), folder), lambda: SG.apply(spark, folder, frame(spark, {1: page(rng, 1)}))):
        with pytest.raises(OSError):
            work()
    monkeypatch.undo()
    assert commits.versions(spark, folder) == [held.number] and searched(spark, SG.opened(spark, folder).index) == searched(spark, held.index)


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    rng, folder = random.Random(5), str(tmp_path / "index")
    SG.build(frame(spark, {k: page(rng, k) for k in range(9)}), folder)
    other, plain, waits = {50: page(rng, 50)}, commits.commit, []

    def late(*args):
        monkeypatch.setattr(commits, "commit", plain)
        SG.apply(spark, folder, frame(spark, other))  # another writer is first
        monkeypatch.setattr(time, "sleep", waits.append)
        plain(*args)

    monkeypatch.setattr(commits, "commit", late)
    got = SG.apply(spark, folder, frame(spark, {51: page(rng, 51)}))
    paths = {r.path for r in B.alive(got.index.pages, got.index.gone).collect()}
    assert {"s2/50.md", "s0/51.md"} <= paths and got.state["n_pages"] == len(paths) == 11
    with pytest.raises(commits.Conflict):
        commits.commit(spark, folder, 0, {})
    assert not [f for f in os.listdir(f"{folder}/_commits") if "json" not in f]


def test_refresh_finds_what_changed(spark, tmp_path):
    rng, folder, table = random.Random(6), str(tmp_path / "index"), str(tmp_path / "pages.parquet")
    pages = {k: page(rng, k) for k in range(40)}

    def refreshed(pages, **options):
        frame(spark, pages).write.mode("overwrite").parquet(table)
        return SG.refresh(spark.read.parquet(table), folder, note=SG.fingerprint(spark, table), **options)

    first = refreshed(pages)
    assert SG.refresh(spark.read.parquet(table), folder, note=SG.fingerprint(spark, table)).number == first.number
    pages[3], pages[90] = page(rng, 3), page(rng, 90)
    del pages[5]
    second = refreshed(pages)
    assert second.number == first.number + 1 and len(second.state["segments"]) == 2
    assert searched(spark, second.index) == searched(spark, B.build(frame(spark, pages)))
    third = refreshed({k: page(rng, k) for k in range(30)})
    assert len(third.state["segments"]) == 1 and third.state["n_pages"] == 30
    assert SG.refresh(spark.read.parquet(table), folder, True, SG.fingerprint(spark, table)).index.stemmed
    empty = SG.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "empty"))
    assert searched(spark, empty.index) == [] and empty.state["n_pages"] == 0
    odd = spark.createDataFrame([(None, "s", "t", "w1"), ("s/a.md", None, None, None), ("s/a.md", "s", "w7", "w7")], SCHEMA)
    assert [r[1] for r in searched(spark, SG.apply(spark, str(tmp_path / "empty"), odd).index)] == ["s/a.md"]


def test_only_the_buckets_of_the_asked_terms_are_read(spark, tmp_path):
    rng = random.Random(7)
    index = SG.build(frame(spark, {k: page(rng, k) for k in range(50)}), str(tmp_path / "index")).index
    phrases = spark.createDataFrame([(["w3"], 1)], "phrase array<string>, n int")
    plan = B._phrase_hits(index, phrases)._jdf.queryExecution().toString()
    bucket = spark.range(1).select(B.bucket_of(F.lit("w3"))).first()[0]
    assert f"PartitionFilters: [isnotnull(bucket" in plan.replace("#", "") or f"(bucket" in plan
    assert any("PartitionFilters: [" in line and str(bucket) in line for line in plan.splitlines())


def test_an_upsert_costs_a_part_of_a_rebuild(spark, sf_dir, tmp_path):
    from sparrowdex.queries import corpus

    c = corpus(spark, "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else sf_dir).cache()
    c.count()
    SG.build(c, str(tmp_path / "a"))
    few = c.filter(F.pmod(F.xxhash64("path"), F.lit(100)) == 0)
    version = SG.apply(spark, str(tmp_path / "a"), few)
    new = [s for s in version.state["segments"] if s["least"]]
    assert sum(s["pages"] for s in new) == few.count() < 0.05 * version.state["n_pages"]
