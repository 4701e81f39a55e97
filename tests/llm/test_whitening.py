"""Whitening against exact arithmetic and numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from fixtures import DATA
from tablegauge.llm import whitening, workload


def brute(vectors):
    """(n, sums, covariance as floats rounded once, x) over the different x vectors."""
    x = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors]
    different = sorted(set(x))
    n, d = len(different), len(different[0])
    sums = [sum(v[i] for v in different) for i in range(d)]
    centred = np.array([[n * a - s for a, s in zip(v, sums)] for v in different], dtype=object)
    cov = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in centred.T @ centred])
    return n, sums, cov, x


def check(df, vectors):
    out, model = whitening.whiten(df)
    n, sums, cov, x = brute(vectors)
    assert model.n == n
    assert [s + 1_000_000 * n for s in model.sums] == sums
    values = np.linalg.eigvalsh(cov)[::-1]
    got = {r["row"]["vec_id"]: r for r in out.collect()}
    assert len(got) == len(vectors)
    k = min(16, len(sums))
    assert np.allclose(model.explained, values[:k] / np.trace(cov), rtol=1e-6, atol=1e-12)
    assert np.allclose(cov @ model.components, model.components * model.variances, atol=1e-9 * values[0])
    for i, v in enumerate(x):
        assert got[i]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(v, sums))
        centred = np.array([float(Fraction(n * a - s, n)) for a, s in zip(v, sums)])
        for w, direction, e in zip(got[i]["whitened"], model.components.T, model.variances):
            assert (w is None) == (e == 0)
            assert w is None or w == pytest.approx(centred @ direction / math.sqrt(e), abs=1e-8)
    assert model.identity_error < 1e-4
    return model


def test_random_vectors(spark):
    rng = np.random.default_rng(5)
    mixing = rng.normal(size=(24, 24))
    vectors = (rng.normal(size=(700, 24)) @ mixing + rng.normal(size=24) * 3).astype(np.float32)
    vectors[200:430] = vectors[0]  # a third of all rows is one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(7)
    model = check(df, vectors)
    assert len(model.variances) == 16 and model.n == 700 - 230


def test_few_dimensions_and_no_variance(spark):
    vectors = [[float(i % 5), 7.25, float(i)] for i in range(40)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    model = check(df, vectors)
    assert (model.variances > 0).tolist() == [True, True, False]
    one = spark.createDataFrame([(0, [1.0, 2.0])] * 3, "vec_id long, embedding array<double>")
    out, model = whitening.whiten(one)
    assert [tuple(r) for r in out.select("deviation", "whitened").collect()] == [(0, [None, None])] * 3 and model.n == 1


def test_large_numbers_stay_exact(spark):
    vectors = [[float(2**30 * (i % 7) + i), float(-(2**31) * (i % 3))] for i in range(50)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    out, model = whitening.whiten(df)
    n, sums, cov, x = brute(vectors)
    assert np.allclose(whitening.components(cov, 16)[1], model.variances, rtol=1e-12)
    # too large for a long, and so null
    assert {r["deviation"] for r in out.collect()} == {None}
    wide = spark.createDataFrame([(0, [1e300]), (1, [-1e300]), (2, [0.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(wide)[0].count() == 3


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (None, [0.5, -2.0]), (7, [3.0]), (8, [4.0, 4.0]), (9, [4.001, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS row", "'x' AS whitened", "2 AS deviation", "3 AS key")
    out, model = whitening.whiten(df)
    assert sorted(map(repr, (r["row"]["vec_id"] for r in out.collect()))) == sorted(map(repr, [1, 1, None, 8, 9]))
    assert model.n == 3  # 8 and 9 are one x vector
    assert whitening.whiten(df.where("false"))[0].count() == 0
    assert whitening.whiten(df.where("vec_id in (2, 3)"))[0].count() == 0


def test_query_on_the_whole_table(spark):
    got = workload.QUERIES["op11_whiten"](spark, DATA)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").where("embedding is not null").collect()
    n, sums, cov, x = brute([r.embedding for r in table])
    values, vectors = np.linalg.eigh(cov)
    ids = {r.vec_id: np.array([a - s / n for a, s in zip(v, sums)]) for r, v in zip(table, x)}
    rows = got.collect()
    assert len(rows) == 16 * len(table) and {r.n for r in rows} == {n} and {r.identity_error < 1e-4 for r in rows} == {True}
    for r in rows:
        e, u = values[-r.component], vectors[:, -r.component]
        assert abs(abs(ids[r.vec_id] @ u / math.sqrt(e)) - abs(r.whitened)) < 1e-6
        assert r.explained == pytest.approx(e / np.trace(cov), rel=1e-4)
