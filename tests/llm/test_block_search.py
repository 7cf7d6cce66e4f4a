import numpy as np
import pytest
from pyspark.sql import functions as F

from dawnpress.llm import block_search


def brute(rows, divisor, k):
    out = {}
    for q, x in rows:
        if q % divisor == 0:
            scores = [(-float(np.dot(x, y)), v) for v, y in rows if v != q and len(x) == len(y)]
            out[q] = [v for _, v in sorted((round(s, 9), v) for s, v in scores)[:k]]
    return out


def found(frame):
    got = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(got[r.query_id])
    return got


def vectors(n, size, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(5, size))
    rows = [(i, (centres[i % 5] * (i % 3) + draw.normal(size=size) * 0.1).astype(np.float32).astype(float).tolist()) for i in range(n)]
    return rows


def test_equals_brute_force(spark):
    rows = vectors(400, 16)
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    result = block_search.nearest(frame.where("vec_id % 20 = 0"), frame, 20, query_block=7, candidate_block=50)
    assert found(result) == brute(rows, 20, 20)
    exact = {r[0]: np.array(r[1]) for r in rows}
    assert all(abs(r.score - exact[r.query_id] @ exact[r.vec_id]) < 1e-12 for r in result.collect())


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100 + i, [0.5, 0.5 + i]) for i in range(5)] + [(200, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(5)
    result = block_search.nearest(frame.where("vec_id % 20 = 0"), frame, 4, query_block=2, candidate_block=9)
    assert found(result) == brute(rows, 20, 4)


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0])]
    rows += [(None, [1.0, 1.0]), (7, [3.0, 1.0]), (7, [1.0, 1.0]), (7, [3.0, 1.0]), (8, [1.0, 1.0, 1.0]), (20, [1.0, 1.0, 2.0]), (40, [-1e-30, 5e-31])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit(1))
    got = found(block_search.nearest_to_every(frame))
    assert got == {0: [7, 40], 20: [8], 40: [0, 7]}


def test_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert block_search.nearest_to_every(empty).collect() == []
    alone = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert block_search.nearest_to_every(alone).collect() == []


@pytest.mark.parametrize("size", [3, 64, 1100])
def test_bounds_hold(size):
    draw = np.random.default_rng(size)
    x = draw.normal(size=(40, size)) * np.exp(draw.normal(size=(40, 1)))
    codes, scale, norm, lost = block_search.rounded(x)
    product = (codes.astype(float) @ codes.astype(float).T) * np.outer(scale, scale)
    slack = norm[:, None] * lost + lost[:, None] * (norm + lost)
    assert (np.abs(product - x @ x.T) <= slack + 1e-9).all()
