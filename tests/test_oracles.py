"""Every registered engine query against its DuckDB SQL."""

import os

import duckdb
import pytest

from sparrowdex.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    got = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in got.select(*sorted(got.columns)).collect()]
    assert rows or name in ("eval_unknown_expectations",)
    if name in ORACLES:
        cols = sorted(got.columns)
        rel = db.sql(ORACLES[name])
        assert sorted(rel.columns) == cols
        want = [tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()]
        assert sorted(map(repr, rows)) == sorted(map(repr, want))
