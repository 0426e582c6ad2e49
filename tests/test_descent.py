"""Averaged descent against a dense version in NumPy, row by row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlint.operators import descent as D

SCHEMA = "row_id long, label string, features array<struct<index:int,value:double>>, other int"
WIDTH = 12


def _rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        label = rng.choice(["a", "b", "c"])
        feats = {rng.randrange(WIDTH): rng.uniform(0.2, 1.0) for _ in range(3)} | {"abc".index(label): rng.uniform(0.3, 1.2)}
        out.append((k, label, sorted(feats.items()), k % 2))
    return out


def plain(rows, order, how, epochs):
    """Dense weights, every iterate added up, penalties as running sums."""
    classes = sorted({r[1] for r in rows})
    final = []
    for c in classes:
        w, b, q, u, t = np.zeros(WIDTH), 0.0, np.zeros(WIDTH), 0.0, 0
        total, total_b = np.zeros(WIDTH), 0.0
        for epoch in range(epochs):
            for k in order[epoch]:
                x = np.zeros(WIDTH)
                for i, v in rows[k][2]:
                    x[i] = v
                y = 1.0 if rows[k][1] == c else -1.0
                eta = 1 / (how.alpha * (how.first + t))
                push = eta * y / (math.exp(y * (w @ x + b)) + 1)
                w *= 1 - (1 - how.share_of_l1) * eta * how.alpha
                w += push * x
                b += push
                if how.share_of_l1:
                    u += how.share_of_l1 * eta * how.alpha
                    for i, _ in rows[k][2]:
                        z = w[i]
                        w[i] = max(0, z - u - q[i]) if z > 0 else min(0, z + u - q[i]) if z < 0 else z
                        q[i] += w[i] - z
                total, total_b, t = total + w, total_b + b, t + 1
        final.append((total / t, total_b / t, w.copy(), b))
    return final


@pytest.mark.parametrize(("penalty", "average"), [("l2", True), ("l1", True), ("elasticnet", True), ("l2", False)])
def test_one_partition_is_sequential(spark, penalty, average):
    rows = _rows(120)
    df = spark.createDataFrame([*rows, (900, None, [(0, 1.0)], 0), (901, "a", None, 0)], SCHEMA)
    how = D.Descent(alpha=1e-2, penalty=penalty, l1_ratio=0.3, epochs=3, average=average, partitions=1)
    order = [[r[0] for r in df.where("row_id < 900").orderBy(F.xxhash64("row_id", F.lit(how.seed + e)), "row_id").select("row_id").collect()] for e in range(3)]
    model, want = D.fit(df, WIDTH, how), plain(rows, order, how, 3)
    assert model.classes == ["a", "b", "c"] and len(model.losses) == 3
    for got, (mean, mean_b, end, end_b) in zip(model.weights, want, strict=True):
        assert np.allclose(got[:-1], mean if average else end, atol=1e-9) and got[-1] == pytest.approx(mean_b if average else end_b, abs=1e-9)


def test_many_partitions_stay_near(spark):
    """Four partitions: the mean loss ends within a tenth of the sequential one, and nine of ten rows get the same class."""
    rows = _rows(600, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    models = [D.fit(df, WIDTH, D.Descent(alpha=1e-3, epochs=8, partitions=p)) for p in (1, 4)]
    assert models[1].losses[-1] == pytest.approx(models[0].losses[-1], rel=0.1)
    said = [{r.row_id: r.prediction for r in D.predicted(df, m).collect()} for m in models]
    assert sum(said[0][k] == said[1][k] for k in said[0]) > 0.9 * len(rows)
    assert sum(said[1][r[0]] == r[1] for r in rows) > 0.8 * len(rows)


@pytest.mark.parametrize(("penalty", "alpha"), [("l2", 1e-2), ("elasticnet", 1e-2), ("l2", 0.9)])
def test_small_walk_is_the_same(penalty, alpha):
    """Plain floats take the steps that arrays take, through weights that shrink to nothing, at less than half the time."""
    import time

    how, rng = D.Descent(alpha=alpha, penalty=penalty, l1_ratio=0.3), np.random.default_rng(3)
    n, at, walks, spent = 6000, np.arange(0, 18001, 3), [], []
    rows = (rng.integers(0, 3, n), at, np.concatenate([rng.choice(WIDTH, 3, replace=False) for _ in range(n)]), rng.uniform(0.1, 1, 3 * n), rng.uniform(0.5, 2, n))
    for kind in (D._Walk, D._SmallWalk):
        walk, began = kind(how, np.zeros((3, WIDTH + 1)), np.zeros((3, WIDTH + 1)), 0.0, 0.0), time.process_time()
        walk.go(*rows)
        spent.append(time.process_time() - began)
        walks.append(walk)
    for a, b in zip((*walks[0].sums(), walks[0].q, walks[0].loss), (*walks[1].sums(), walks[1].q, walks[1].loss), strict=True):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9)
    assert spent[1] < spent[0] / 2


def test_two_classes_are_one_machine(spark):
    rows = [(k, "ab"[x % 2], [(x % 2, 1.0), (2 + k % 3, 0.5)], 0) for k, x in enumerate([0, 1] * 40)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = D.fit(df, WIDTH, D.Descent(alpha=1e-2, epochs=2, partitions=1))
    order = [[r[0] for r in df.orderBy(F.xxhash64("row_id", F.lit(42 + e)), "row_id").select("row_id").collect()] for e in range(2)]
    want = plain(rows, order, D.Descent(alpha=1e-2), 2)
    assert model.weights.shape == (2, WIDTH + 1) and (model.weights[1] == -model.weights[0]).all()
    for got, (mean, mean_b, _, _) in zip(model.weights, want, strict=True):
        assert np.allclose(got[:-1], mean, atol=1e-9) and got[-1] == pytest.approx(mean_b, abs=1e-9)


def test_stopping_and_errors(spark):
    df = spark.createDataFrame(_rows(60), SCHEMA)
    assert len(D.fit(df, WIDTH, D.Descent(epochs=50, tol=10.0, n_iter_no_change=2, partitions=1)).losses) == 3  # the first epoch always counts
    with pytest.raises(ValueError, match="no labelled"):
        D.fit(df.limit(0), WIDTH)
    with pytest.raises(ValueError, match="too large"):
        D.fit(df, D.MOST_WEIGHTS)
    model = D.LinearModel(["x", "y"], np.array([[1.0, 0.0], [1.0, 0.0]]))
    (tie, none) = D.predicted(spark.createDataFrame([(1, [(0, 1.0)]), (2, None)], "row_id long, features array<struct<index:int,value:double>>"), model).orderBy("row_id").collect()
    assert tie.prediction == "x" and none.prediction is None and tie.decisions == {"x": 1.0, "y": 1.0}


def test_vectors_as_entries(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.sparse(4, {1: 2.0}),), (Vectors.dense([0.0, 0.0, 3.0, 0.0]),)], ["v"])
    assert [[(p["index"], p["value"]) for p in r.e] for r in df.select(D.entries(F.col("v")).alias("e")).collect()] == [[(1, 2.0)], [(2, 3.0)]]
