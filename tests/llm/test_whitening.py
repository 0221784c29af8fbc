from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardenlake.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def test_inertia_counts_against_eigenvalues():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 20):
        for _ in range(10):
            a = rng.normal(size=(n, n))
            a = a + a.T
            if n > 2:
                np.fill_diagonal(a, 0)  # needs blocks of two
            values = np.linalg.eigvalsh(a)
            for shift in rng.normal(size=5) * n:
                assert W.above(a, shift) == (values > shift).sum()
    assert W.positives(np.zeros((4, 4))) == 0


@pytest.mark.parametrize("values", [np.arange(40, 0, -1.0), 2.0 ** -np.arange(40), np.r_[9, 9, 9, 5, 5 - 1e-9, 4, 3, np.zeros(33)], 1 + np.arange(40) * 1e-7])
def test_leading_components(values):
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    a = q * values @ q.T
    a = (a + a.T) / 2
    got, vectors = W.leading(a, 16)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:16]
    want = want[want > 1e-12 * want[0]]
    assert len(got) == len(want) and np.abs(got - want).max() <= 1e-13 * want[0] and (np.diff(got) <= 0).all()
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * got).max() < 1e-13 * want[0]


def brute(rows, k):
    x = np.array([[floor(64 * float(c)) + 1000000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    centred = np.array([[float(n * a - b) / n for a, b in zip(row, s)] for row in x])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return {i: (sum((n * a - b) ** 2 for a, b in zip(row, s)), c @ vectors / np.sqrt(values), values / np.trace(v)) for (i, _), row, c in zip(rows, x, centred)}


def test_against_plain_linear_algebra(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(40, 40))
    good = [(i, (rng.normal(size=40) @ mix + 3).tolist()) for i in range(300)] + [(400, [0.0] * 40), (401, [0.0] * 40)]
    odd = [(900, None), (901, []), (902, [NAN] + [1.0] * 39), (903, [INF] + [1.0] * 39), (904, [None] + [1.0] * 39)]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + odd], SCHEMA).withColumn("id", F.lit("clash")).withColumn("n", F.lit("clash")).withColumn("v", F.lit("clash"))
    rows = W.whiten(df).collect()
    want = brute(good, 32)
    assert len(rows) == 32 * len(good) and {r["vec_id"] for r in rows} == {i for i, _ in good}
    sign = {}
    for r in rows:
        deviation, white, explained = want[r["vec_id"]]
        k = r["component"] - 1
        assert r["n"] == len(good) and r["deviation"] == deviation and abs(r["explained"] - explained[k]) < 1e-9 * explained[k] and r["identity_error"] < 1e-9
        if abs(white[k]) > 0.1:
            sign.setdefault(k, np.sign(white[k] * r["whitened"]))
            assert abs(r["whitened"] - sign[k] * white[k]) < 1e-6


def test_lengths_repeats_equal_vectors_and_empty_tables(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [2.0, 5.0]), (2, [3.0, -1.0]), (5, [1.0, 1.0, 1.0]), (6, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    got = sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in W.whiten(df).collect())
    assert got == [(0, 1, 4), (0, 2, 4), (1, 1, 4), (1, 1, 4), (1, 2, 4), (1, 2, 4), (2, 1, 4), (2, 2, 4)]  # equal vectors have no component
    assert W.whiten(df.limit(0)).count() == 0


def test_entries_beyond_a_long(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 4.0])]
    got = W.whiten(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)).collect()
    assert all(r["deviation"] is None for r in got if r["vec_id"] < 3) and all(np.isfinite(r["whitened"]) for r in got)
