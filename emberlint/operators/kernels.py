"""Kernel machines: rows mapped by a kernel against a bounded set of landmarks, so that a linear machine does the rest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Landmarks of a map, at most: a square matrix of these is decomposed by the driver.
MOST_LANDMARKS = 1000


@dataclass(frozen=True)
class Kernel:
    """rbf: exp(-gamma |x - y|^2); poly: (gamma x.y + coef0)^degree."""

    name: str = "rbf"
    gamma: float = 1.0
    degree: int = 3
    coef0: float = 0.0

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.name == "poly":
            return (self.gamma * x @ y.T + self.coef0) ** self.degree
        if self.name == "rbf":
            return np.exp(-self.gamma * np.maximum(0.0, (x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T))
        raise ValueError(f"unknown kernel: {self.name}")


@dataclass
class KernelMap:
    """Places rows so that products of places are the kernel of the rows, exactly for landmarks and nearly for what lies near them."""

    kernel: Kernel
    landmarks: np.ndarray
    root: np.ndarray  # inverse square root of the landmarks' kernel matrix

    def places(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x, self.landmarks) @ self.root

    def error(self, x: np.ndarray) -> float:
        """Largest difference of kernel and product among the rows ``x``."""
        z = self.places(x)
        return float(np.abs(z @ z.T - self.kernel(x, x)).max()) if len(x) else 0.0


def _sample(df: DataFrame, features: str, key: str, most: int, seed: int) -> np.ndarray:
    rows = df.where(F.col(features).isNotNull()).orderBy(F.xxhash64(key, F.lit(seed)), key).select(features).limit(most).collect()
    return np.array([r[0] for r in rows], float)


def fit(df: DataFrame, kernel: Kernel | None = None, landmarks: int = 200, features: str = "features", key: str = "row_id", seed: int = 42) -> KernelMap:
    """A map from ``landmarks`` rows (at most ``MOST_LANDMARKS``), those of least hash of the key; ``features`` is an array of numbers. Null features are left out."""
    if not 0 < landmarks <= MOST_LANDMARKS:
        raise ValueError(f"between 1 and {MOST_LANDMARKS} landmarks")
    kernel = kernel or Kernel()
    chosen = _sample(df, features, key, landmarks, seed)
    if not len(chosen):
        raise ValueError("no row with features")
    values, vectors = np.linalg.eigh(kernel(chosen, chosen))
    kept = values > max(values.max(), 0.0) * 1e-10
    return KernelMap(kernel, chosen, vectors[:, kept] / np.sqrt(values[kept]))


def measured_error(df: DataFrame, found: KernelMap, rows: int = 500, features: str = "features", key: str = "row_id", seed: int = 7) -> float:
    """The map's error among ``rows`` rows that a hash chooses."""
    return found.error(_sample(df, features, key, rows, seed))


def mapped(df: DataFrame, found: KernelMap, features: str = "features", to: str = "features") -> DataFrame:
    """``df`` with the places of its rows in column ``to``, an array of numbers; null where the features are. One pass without a shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(found)
    kept = [f for f in df.schema.fields if f.name != to]
    schema = T.StructType([*kept, T.StructField(to, T.ArrayType(T.DoubleType()))])

    def run(batches):
        m = shared.value
        for b in batches:
            x = b.column("_x")
            some = x.is_valid().to_numpy(zero_copy_only=False)
            out: list = [None] * b.num_rows
            if some.any():
                z = m.places(np.array(x.drop_null().to_pylist(), float))
                for k, row in zip(np.flatnonzero(some).tolist(), z.tolist(), strict=True):
                    out[k] = row
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(out, pa.list_(pa.float64()))], names=[*(f.name for f in kept), to])

    return df.select(*(F.col(f.name) for f in kept), F.col(features).cast("array<double>").alias("_x")).mapInArrow(run, schema)
