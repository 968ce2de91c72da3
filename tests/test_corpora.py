"""Versioned corpora: batches, several writers, swaps that break off, rollback, vacuum."""

import os

import pytest
from pyspark.sql import functions as F

from sparrowdex.operators import manifest as M
from sparrowdex.operators import policy as P
from sparrowdex.streaming import commits, corpora

SCHEMA = "path string, source string, body string"


def pages(spark, *rows):
    return spark.createDataFrame([(p, p.split("/")[0] if p else None, b) for p, b in rows], SCHEMA)


def held(spark, folder, version=None):
    found = corpora.current(spark, folder, version)
    return {} if found is None else {r.path: r.body for r in found.collect()}


def stream(spark, tmp_path, name, folder, **options):
    changes = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / name))
    corpora.upsert_stream(changes, folder, str(tmp_path / f"{name}-checkpoint"), 4, **options).awaitTermination()


def test_a_stream_s_versions(spark, tmp_path):
    """Versions are whole; a batch that is run again changes nothing; what was left unfinished is nobody's."""
    folder = str(tmp_path / "corpus")
    assert corpora.current(spark, folder) is None and not corpora.changed_since(spark, folder, 0)
    for rows in ([("a", "1"), ("b", "1"), ("c", "1")], [("a", "2"), ("a", "1"), (None, "9")], [("d", "3")]):
        pages(spark, *rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
        os.makedirs(f"{folder}/data/unfinished/bucket=1", exist_ok=True)
        stream(spark, tmp_path, "changes", folder)
    assert held(spark, folder) == {"a": "2", "b": "1", "c": "1", "d": "3"} and held(spark, folder, 0) == {"a": "1", "b": "1", "c": "1"}
    assert corpora.changed_since(spark, folder, 1) and not corpora.changed_since(spark, folder, 2)
    for f in os.listdir(tmp_path / "changes-checkpoint" / "commits"):  # stopped after the version, before the stream's own commit
        if f.lstrip(".").startswith("2"):
            os.remove(tmp_path / "changes-checkpoint" / "commits" / f)
    stream(spark, tmp_path, "changes", folder)
    assert commits.versions(spark, folder) == [0, 1, 2] and len(held(spark, folder)) == 4
    assert "unfinished" in corpora.vacuum(spark, folder, keep=1, older=-1) and len(held(spark, folder)) == 4


def test_two_streams_lose_nothing(spark, tmp_path):
    folder = str(tmp_path / "corpus")
    for name, rows in (("one", [("x/a", "1"), ("x/b", "1")]), ("two", [("x/c", "2"), ("x/b", "2")])):
        pages(spark, *rows).write.parquet(str(tmp_path / name))
        stream(spark, tmp_path, name, folder)
    assert held(spark, folder) == {"x/a": "1", "x/b": "2", "x/c": "2"}
    # A new checkpoint reads all again, and so does one under the old name, whose batch is known.
    for options, again in (({}, True), ({"stream": str(tmp_path / "one-checkpoint")}, False)):
        os.rename(tmp_path / "one-checkpoint", tmp_path / f"old-{again}") if (tmp_path / "one-checkpoint").exists() else None
        before = commits.versions(spark, folder)
        stream(spark, tmp_path, "one", folder, **({"stream": "another"} if again else options))
        assert (commits.versions(spark, folder) != before) == again
    assert held(spark, folder)["x/b"] == "1"


@pytest.mark.parametrize("same_bucket", [True, False])
def test_writers_at_the_same_time(spark, tmp_path, monkeypatch, same_bucket):
    folder = str(tmp_path / "corpus")
    corpora.publish(spark, folder, pages(spark, *((f"s/{k}", "0") for k in range(12))), buckets=1 if same_bucket else 16)
    plain, seen = commits.commit, []

    def late(*args):
        monkeypatch.setattr(commits, "commit", lambda *a: (seen.append(a[3]), plain(*a)))
        corpora.publish(spark, folder, pages(spark, ("s/other", "1")), removed=pages(spark, ("s/3", "")))
        plain(*args)

    monkeypatch.setattr(commits, "commit", late)
    corpora.publish(spark, folder, pages(spark, ("s/mine", "2")))
    got = held(spark, folder)
    assert got["s/other"] == "1" and got["s/mine"] == "2" and "s/3" not in got and len(got) == 13
    assert commits.versions(spark, folder) == [0, 1, 2]


def test_swaps(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "corpus")
    old = {"a/1": "old", "a/2": "old", "b/1": "old"}
    corpora.publish(spark, folder, pages(spark, *old.items()), buckets=4)
    new = pages(spark, ("a/2", "new"), ("a/3", "new"))

    def stop(*_):
        raise OSError("stopped")

    for where, what in ((commits, "commit"), (commits, "read"), (corpora.uuid, "uuid4")):
        with monkeypatch.context() as m:
            m.setattr(where, what, stop)
            with pytest.raises(OSError):
                corpora.swap_source(spark, folder, new, "a")
        assert held(spark, folder) == old
    assert corpora.swap_source(spark, folder, new, "a") == 1
    assert held(spark, folder) == {"a/2": "new", "a/3": "new", "b/1": "old"}
    corpora.rollback(spark, folder, 0)
    assert held(spark, folder) == old
    corpora.publish(spark, folder, sources=["a", "none"])
    assert held(spark, folder) == {"b/1": "old"}
    corpora.publish(spark, folder, sources=["b"])
    assert held(spark, folder) == {}
    corpora.publish(spark, folder, new)
    assert len(held(spark, folder)) == 2


def test_seeding(spark, tmp_path):
    folder = str(tmp_path / "corpus")
    corpora.publish(spark, folder, pages(spark, ("lib__v1/a", "old")), buckets=4)
    wanted = spark.createDataFrame([("lib", "1"), ("lib", "2"), ("kit", "7")], "family string, version string")
    plan = P.seed_plan(wanted, corpora.current(spark, folder))

    def pull(source, family, version):
        if family == "kit" and not sound:
            raise OSError("no such version")
        return pages(spark, (f"{source}/a", version))

    sound = False
    with pytest.raises(OSError):
        corpora.seed(spark, folder, plan, pull)
    assert held(spark, folder) == {"lib__v1/a": "old"}
    sound = True
    corpora.seed(spark, folder, plan, pull)
    assert held(spark, folder) == {"lib__v1/a": "old", "lib__v2/a": "2", "kit__v7/a": "7"}
    assert corpora.seed(spark, folder, P.seed_plan(wanted, corpora.current(spark, folder)), pull) is None
    corpora.rollback(spark, folder, 0)
    assert held(spark, folder) == {"lib__v1/a": "old"}


def test_replacing_sources_by_name(spark):
    base = pages(spark, ("a/1", "x"), ("b/1", "x"), (None, "x"))
    got = M.replace_source(base, base.limit(0), sources=["a"])
    assert sorted((r.path or "") for r in got.collect()) == ["", "b/1"]
    assert M.replace_source(base, pages(spark, ("a/9", "y"), ("c/1", "y")), sources=["a"]).filter(F.col("path").isin("a/9", "b/1")).count() == 2
