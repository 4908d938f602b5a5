"""The inverted file against brute force: ties, copies, nulls, few vectors, blocks, and what it leaves out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternrow.operators import ivf, retrieval


def brute(vectors, queries, k):
    out = []
    for q, v in queries:
        if v is not None:
            ranked = sorted((-round(float(np.dot(np.float64(v), np.float64(x))), 9), key) for key, x in vectors if x is not None)
            out += [(q, key, n + 1) for n, (_, key) in enumerate(ranked[:k])]
    return sorted(out)


def tables(spark, vectors, queries):
    return spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), spark.createDataFrame(queries, "query_id string, embedding array<float>")


@pytest.mark.parametrize("small", [False, True])
def test_nearest_equals_brute_force(spark, monkeypatch, small):
    if small:  # many blocks of vectors and queries
        monkeypatch.setattr(ivf, "BLOCK", 7)
        monkeypatch.setattr(ivf, "ASKED", 3)
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 6)).astype(np.float32)
    x[100:220] = x[50]  # copies: equal scores go by key
    x[300] = 0
    vectors = [(i * 3 % 1201, [float(v) for v in row]) for i, row in enumerate(x)] + [(5000, None)]
    queries = [(f"q{i}", [float(v) for v in row]) for i, row in enumerate(x[40:60] * 1.5)] + [("none", None), ("zero", [0.0] * 6)]
    v, q = tables(spark, vectors, queries)
    got, looked = ivf.build(v, cells=12).search(q, 9)
    assert got.columns == ["query_id", "vec_id", "score", "rank"]
    assert sorted((g.query_id, g.vec_id, g["rank"]) for g in got.collect()) == brute(vectors, queries, 9)
    assert all(0 < n.n_scored <= 400 for n in looked.collect())
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_few_vectors_and_none(spark):
    v, q = tables(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], [("a", [2.0, 1.0])])
    assert [(g.vec_id, g["rank"], g.score) for g in retrieval.dense(v, q, 5).orderBy("rank").collect()] == [(1, 1, 2.0), (2, 2, 1.0)]
    assert retrieval.dense(v.limit(0), q, 5).count() == 0
    assert retrieval.dense(v, q.limit(0), 5).count() == 0


def test_bounds_leave_cells_out_of_grouped_vectors(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(20, 16))
    x = np.repeat(centres, 100, 0) + r.normal(size=(2000, 16)) * 0.05
    vectors = [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    queries = [(f"q{i}", vectors[i][1]) for i in range(0, 2000, 50)]
    v, q = tables(spark, vectors, queries)
    got, looked = ivf.build(v, cells=20).search(q, 5)
    assert sorted((g.query_id, g.vec_id, g["rank"]) for g in got.collect()) == brute(vectors, queries, 5)
    assert looked.agg(F.sum("n_scored")).first()[0] < 0.25 * 2000 * 40
