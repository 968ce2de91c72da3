"""What the finding of round 4 named: bytes of vector_cosine's result, which has to stay whole and equal to its SQL."""

import math
from pathlib import Path

import duckdb
import numpy as np

from sparrowdex.operators import vectors as V
from sparrowdex.queries import ORACLES, QUERIES


def test_result_of_cosines_is_stored_in_few_bytes(spark, tmp_path):
    """1,200 questions against 6,000 vectors with copies: every row of the SQL, 8.2 bytes of each before."""
    r = np.random.default_rng(4)
    base = r.normal(size=(6000, 64)).astype(np.float32)
    base[5000:] = base[:1000]
    rows = [(20 * i if i < 1200 else 100_000 + 20 * i + 1, base[i].tolist(), 0) for i in range(6000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    QUERIES["vector_cosine"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/got")
    assert sum(f.stat().st_size for f in Path(f"{tmp_path}/got").glob("*.parquet")) < 5.5 * 7_200_000
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    db.execute(f"CREATE VIEW got AS SELECT * FROM '{tmp_path}/got/*.parquet'")
    (found,) = db.sql(f"WITH w AS ({ORACLES['vector_cosine']}) SELECT count(*), count(w.qid), count(got.qid), count(*) FILTER (w.score = got.score AND signbit(w.score) = signbit(got.score)) FROM w FULL JOIN got USING (qid, vec_id)").fetchall()
    assert found == (7_200_000,) * 4


def test_bands_hold_every_pair_once(spark):
    """Dimensions that differ, all-zero, missing, NaN and infinite vectors, copies and exact cosines, with enough questions for bands."""
    r = np.random.default_rng(5)
    odd = [None, [], [0.0] * 4, [1.0, 0.0, 0.0, 0.0], [-1.0, 0.0, 0.0, 0.0], [1.0, 1.0, 0.0, 0.0], [math.nan, 1.0, 0.0, 0.0], [math.inf, 1.0, 0.0, 0.0], [1.0]]
    some = [r.normal(size=3 + i % 2).tolist() for i in range(1100)]
    q = spark.createDataFrame(list(enumerate([*odd, *some])), "qid long, embedding array<double>")
    v = spark.createDataFrame(list(enumerate([*odd, *some[:40], *odd])), "vec_id int, embedding array<double>").coalesce(1)
    plain = {(x.qid, x.vec_id): x.score for x in V.cosines(v, q).collect()}
    got = V.cosines(v, q, digits=6, block=1050).collect()
    assert len(got) == len(plain) == 1109 * 58
    assert {(x.qid, x.vec_id) for x in got} == plain.keys()
    assert all(math.isnan(plain[x.qid, x.vec_id]) if math.isnan(x.score) else abs(x.score - plain[x.qid, x.vec_id]) <= 5.000001e-7 for x in got)
    assert sum(math.isnan(x.score) for x in got) > 500


def test_bands_and_rounding():
    borders = np.array([(k - 0.2718) / V.BANDS for k in range(-V.BANDS, V.BANDS + 2)])
    x = np.concatenate([borders, np.nextafter(borders, 2), np.nextafter(borders, -2), [0.0, -0.0, 0.5, math.nan, 1.0, -1.0, np.nextafter(1.0, 2), np.nextafter(-1.0, -2)], np.linspace(-1, 1, 1001)])
    x = x[~(np.abs(x) > 1.01)]
    assert (sum(V.in_band(x, b).astype(int) for b in range(V.BANDS)) == 1).all()
    x = np.concatenate([x, [2.5e-7, -2.5e-7, 5e-7, -5e-7, 0.1234565, -0.1234565, 0.9999995], np.random.default_rng(6).normal(size=10_000)])
    want = duckdb.sql("SELECT round(unnest($x), 6)", params={"x": x.tolist()}).fetchall()
    assert list(map(repr, V.rounded(x, 6).tolist())) == [repr(w) for (w,) in want]
