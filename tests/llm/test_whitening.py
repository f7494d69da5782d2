"""Whitening against exact sums and a dense eigenvalue decomposition."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyproof.llm import whitening
from tallyproof.llm.whitening import jacobi, triangle

SCHEMA = "vec_id long, embedding array<float>, x array<int>, n long, s string, part int, component string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, [1], 2, "s", 3, "c") for i, v in vectors], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("dim", [1, 2, 3, 16, 33])
def test_jacobi(dim):
    x = np.random.default_rng(dim).normal(size=(200, dim)) * np.geomspace(1, 1e-6, dim)
    length, v = jacobi(triangle(x))
    u, s, w = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(length, s, rtol=1e-10)
    assert np.allclose(np.abs((v * w.T).sum(axis=0)), 1)
    assert np.allclose(v.T @ v, np.eye(dim), atol=1e-13)


def test_jacobi_without_variance():
    length, v = jacobi(np.zeros((4, 4)))
    assert not length.any() and np.allclose(v.T @ v, np.eye(4))


@pytest.mark.parametrize("dim,count,parts", [(5, 300, 7), (12, 400, 3), (9, 4, 2)])
def test_against_dense(spark, dim, count, parts):
    rng = np.random.default_rng(dim)
    base = (rng.normal(size=(count, dim)) @ rng.normal(size=(dim, dim))).astype(np.float32)
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    odd = [(None, vectors[0][1]), (7, vectors[1][1]), (1, None), (2, [None] * dim), (3, [float("nan")] * dim), (4, [float("inf")] * dim), (5, [1.0] * (dim + 1)), (6, []), (8, [1e30] * dim)]
    found = whitening.whiten(table(spark, vectors + odd).repartition(parts)).toPandas().sort_values(["vec_id", "component", "deviation"], na_position="last")
    used = np.array([v for _, v in vectors] + [vectors[0][1], vectors[1][1]], np.float32).astype(float)
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in used.tolist()]
    n = len(x)
    s = [sum(col) for col in zip(*x)]
    exact = [sum((n * a - b) ** 2 for a, b in zip(v, s)) for v in x]
    y = np.array([[(n * a - b) / n for a, b in zip(v, s)] for v in x])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(8, dim)
    assert len(found) == n * k and set(found["n"]) == {n}
    assert sorted(found["deviation"]) == sorted(v for v in exact for _ in range(k))
    real = e[:k] > e[0] * 1e-12
    assert np.allclose(found["explained"][:k], e[:k] / e.sum(), rtol=1e-4, atol=1e-12)
    one = found[found["vec_id"] == 3].sort_values("component")["whitened"].to_numpy()
    assert np.allclose(np.abs(one[real]), np.abs((y[3] @ u[:, :k] / np.sqrt(np.maximum(e[:k], 1e-300)))[real]), rtol=1e-6)
    assert np.isnan(one[~real]).all()
    assert found["identity_error"].max() < 1e-9


def test_deviation_beyond_a_long_is_null(spark):
    got = rows_of(whitening.whiten(table(spark, [(1, [2.0**36, 0.0]), (2, [-(2.0**36), 1.0]), (3, [0.0, 0.0])])))
    assert {r[0]: r[3] for r in got}[1] is None and {r[0]: r[3] for r in got}[3] is not None


def test_one_direction_only(spark):
    got = rows_of(whitening.whiten(table(spark, [(i, [float(i), 1.0, 2.0]) for i in range(5)])))
    by = {(r[0], r[1]): r for r in got}
    assert all(by[i, 1][4] is not None and by[i, 2][4] is None and by[i, 3][4] is None for i in range(5))
    assert abs(by[0, 1][5] - 1) < 1e-12 and by[0, 1][6] < 1e-12


def test_equal_vectors_and_empty_tables(spark):
    got = rows_of(whitening.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(3)])))
    assert len(got) == 6 and all(r[3] == 0 and r[4] is None and r[5] is None and r[6] is None for r in got)
    assert rows_of(whitening.whiten(table(spark, []))) == []
    assert rows_of(whitening.whiten(table(spark, [(1, None), (2, [])]))) == []


def test_reruns_agree(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    a, b = (whitening.whiten(p).select("vec_id", "component", F.round("whitened", 9).alias("w"), "deviation") for p in (df, df.repartition(5)))
    assert a.exceptAll(b).count() == 0
