"""Operator 11 against its SQL and against all scores."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.llm import negatives, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, low=(4, 5), k=5):
    """The result by definition: every score, in Python's integers."""
    usable = []
    for vec_id, label, vec in rows:
        if vec_id is None or label is None or vec is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        usable.append((vec_id, label, [int(np.floor(256 * float(np.float32(x)))) for x in vec]))
    out = []
    for i, (anchor, kind, a) in enumerate(usable):
        if anchor % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, v, strict=False)), vec_id, label) for j, (vec_id, label, v) in enumerate(usable) if j != i), key=lambda x: x[:2])
        for s, positive, label in [x for x in scored if x[2] == kind][:k]:
            fits = [(-n, vec_id) for n, vec_id, other in scored if other != kind and low[0] * -s <= low[1] * -n and -n <= -s][:k]
            out += [(anchor, positive, r, vec_id, -s, n) for r, (n, vec_id) in enumerate(fits, 1)]
    return sorted(out)


def mined(df, **more):
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **more).collect()))


def test_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    got = queries.op11_negatives(spark, SF)
    want = c.execute(f"select {','.join(got.columns)} from ({queries.ORACLE_SQL['op11_negatives']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_odd_rows(spark):
    """Nulls, other numbers, ties, repeated rows and ids, vectors of several lengths, clashing names."""
    random = np.random.default_rng(3)
    rows = [(i, i % 3, random.integers(-2, 3, 4).astype(float).tolist()) for i in range(201)]
    rows += [(0, 0, [1.0, 1.0, 1.0, 1.0]), (7, 1, [1.0, 1.0]), (8, 2, []), (100, None, [1.0] * 4), (200, 1, None), (300, 1, [1.0, None, 1.0, 1.0])]
    rows += [(400, 1, [float("nan"), 1.0, 1.0, 1.0]), (500, 1, [float("inf")] * 4), (None, 1, [9.0] * 4), rows[5], rows[5]]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], f"{SCHEMA}, row int, list int, `rank` int")
    want = brute(rows)
    assert want and mined(df) == want
    assert mined(df, max_lists=1, tile_rows=8) == want


def test_hot_list_and_no_rows(spark):
    """A third of all rows are one vector: its list is dealt to many tiles; no rows give none."""
    random = np.random.default_rng(5)
    rows = [(i, i % 2, [0.5, 0.25, 0.125]) for i in range(100)] + [(i, i % 4, random.normal(size=3).astype(np.float32).tolist()) for i in range(100, 301)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df, tile_rows=16) == brute(rows)
    assert mined(df.where("false")) == [] and mined(df.where("vec_id % 100 <> 0")) == []


def test_large_numbers():
    """Where float64 products aren't exact, whole numbers are used."""
    a, b = np.array([[1 << 30, 3]]), np.array([[(1 << 30) + 1, 5], [1 << 62, 0]])
    assert negatives.scores(a, b).tolist() == [[(1 << 60) + (1 << 30) + 15, (1 << 63) - 1]]


def test_bounds_hold():
    random = np.random.default_rng(1)
    rows, queries_ = random.integers(-200, 200, (500, 16)), random.integers(-200, 200, (20, 16))
    centroids = negatives.fitted(rows, 12)
    own, far = negatives._nearest(rows.astype(float), centroids)
    radii = np.array([far[own == c].max(initial=0) for c in range(len(centroids))])
    high, low = negatives._bounds(queries_, negatives.Lists(centroids, radii, np.ones(len(centroids))))
    s = negatives.scores(queries_, rows)
    assert (s <= high[:, own]).all() and (s >= low[:, own]).all()


@pytest.mark.parametrize("lists", [1, 40])
def test_search_is_exact_whatever_the_lists(spark, lists):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    few = sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, max_lists=lists).collect()))
    assert few == sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect()))
