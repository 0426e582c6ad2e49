"""Kernel maps: exact on landmarks, near elsewhere, and rings that no line separates."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from emberlint.operators import kernels as K

SCHEMA = "row_id long, label double, features array<double>, other string"


def _rings(n, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        far, turn = k % 2 + 1 + rng.uniform(-0.2, 0.2), rng.uniform(0, 2 * math.pi)
        out.append((k, float(k % 2), [far * math.cos(turn), far * math.sin(turn)], "x"))
    return out


@pytest.mark.parametrize("kernel", [K.Kernel("rbf", 0.7), K.Kernel("poly", 0.5, 2, 1.0)])
def test_error(spark, kernel):
    df = spark.createDataFrame([*_rings(300), (900, 1.0, None, "x")], SCHEMA)
    whole, few = K.fit(df, kernel, 300), K.fit(df, kernel, 120)
    assert K.measured_error(df, whole, 300) < 1e-4
    assert K.measured_error(df, few, 300) < 0.05  # 120 landmarks of 300 rows; forty leave an error of up to 0.45 with the radial kernel
    rows = {r.row_id: r for r in K.mapped(df, few).collect()}
    assert rows[900].features is None and rows[900].other == "x" and len(rows) == 301
    x = np.array([r[2] for r in _rings(300)])
    assert np.allclose([rows[k].features for k in range(300)], few.places(x))


def test_rings(spark):
    df = spark.createDataFrame(_rings(400), SCHEMA)
    found = K.fit(df, K.Kernel("rbf", 1.0), 60)
    right = []
    for rows in (df, K.mapped(df, found)):
        ready = rows.withColumn("features", array_to_vector("features"))
        model = LinearSVC(maxIter=40, regParam=0.001).fit(ready)
        right.append(model.transform(ready).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0])
    assert right[0] < 0.7 and right[1] > 0.97


def test_errors(spark):
    df = spark.createDataFrame(_rings(5), SCHEMA)
    with pytest.raises(ValueError, match="landmarks"):
        K.fit(df, landmarks=K.MOST_LANDMARKS + 1)
    with pytest.raises(ValueError, match="no row"):
        K.fit(df.limit(0))
    with pytest.raises(ValueError, match="unknown kernel"):
        K.fit(df, K.Kernel("sine"))
    assert K.mapped(df.limit(0), K.fit(df)).count() == 0
