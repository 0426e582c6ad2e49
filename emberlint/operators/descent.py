"""Averaged stochastic gradient descent for logistic classifiers, each class against the rest, over the partitions of a table.

In an epoch every partition goes through its rows one by one, from the weights that all share; the weights that the partitions
end with are averaged by their rows. On one partition this is plain sequential descent. Only weights meet: a partition
sends those it has, by class and feature, sums are Spark's, and the driver holds one model, whose size is checked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlint.sources.tables import written

#: Numbers that a model may have, classes times features: 400 MB, thrice while it is fitted.
MOST_WEIGHTS = 50_000_000
#: Up to this many numbers, and this many of them for a row and class, steps are taken on plain floats, of which one costs less than a call of NumPy.
SMALL_MODEL, SHORT_ROW = 1 << 18, 64
_SENT = "class int, index array<int>, w array<double>, mean array<double>, q array<double>, loss double"


@dataclass
class Descent:
    """How to descend. The rate of a step t is 1 / (alpha (t + t0)), t0 such that the first is about the size that weights should have."""

    alpha: float = 1e-4
    penalty: str = "l2"  # l1, l2 or elasticnet
    l1_ratio: float = 0.15
    epochs: int = 1000
    tol: float = 1e-3
    n_iter_no_change: int = 5
    average: bool = True
    seed: int = 42
    partitions: int | None = None

    @property
    def share_of_l1(self) -> float:
        return {"l1": 1.0, "l2": 0.0, "elasticnet": self.l1_ratio}[self.penalty]

    @property
    def first(self) -> float:
        return 1.0 / (self.alpha * np.sqrt(1.0 / np.sqrt(self.alpha)))


@dataclass
class LinearModel:
    """Weights (class, feature + 1), the last column the intercepts, and the classes in order."""

    classes: list
    weights: np.ndarray
    losses: list[float] = field(default_factory=list)  # mean loss of each epoch

    def decision(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        return self.weights[:, index] @ value + self.weights[:, -1]


def entries(vector: Column) -> Column:
    """A vector of pyspark.ml as the array of (index, value) that is used here, zeros left out."""
    from pyspark.ml.functions import vector_to_array

    pairs = F.transform(vector_to_array(vector), lambda v, k: F.struct(k.cast("int").alias("index"), v.alias("value")))
    return F.filter(pairs, lambda p: p["value"] != 0)


class _Walk:
    """One pass over a partition. Weights are ``scale * v``, so that decay costs nothing, and means of all iterates come from what each step adds."""

    def __init__(self, how: Descent, weights: np.ndarray, q: np.ndarray, steps: float, u: float):
        self.how, self.v, self.q, self.t, self.u = how, weights.copy(), q.copy(), steps, u
        self.scale, self.scales, self.late = 1.0, 0.0, np.zeros_like(weights)
        self.bias, self.bias_sum = weights[:, -1].copy(), np.zeros(len(weights))
        self.loss = np.zeros(len(weights))
        self.rows = 0

    def step(self, y: np.ndarray, index: np.ndarray, value: np.ndarray, weight: float) -> None:
        how = self.how
        eta = 1.0 / (how.alpha * (how.first + self.t))
        z = y * (self.scale * (self.v[:, index] @ value) + self.bias)
        self.loss += np.where(z > 18, np.exp(-np.maximum(z, 18)), np.where(z < -18, -z, np.log1p(np.exp(-np.clip(z, -18, 18)))))
        push = weight * eta * np.where(z > 18, np.exp(-np.maximum(z, 18)), np.where(z < -18, 1.0, 1.0 / (np.exp(np.clip(z, -18, 18)) + 1.0))) * y
        self.scale *= max(0.0, 1.0 - (1.0 - how.share_of_l1) * eta * how.alpha)
        if self.scale < 1e-9:
            self.late += (self.scale - 1.0) * self.v * self.scales
            self.v *= self.scale
            self.scale = 1.0
        old = self.v[:, index]
        new = old + push[:, None] * value / self.scale
        if how.share_of_l1:
            # What each weight owes of the penalty is taken when its feature comes up, and never beyond zero.
            self.u += how.share_of_l1 * eta * how.alpha
            w, q = new * self.scale, self.q[:, index]
            kept = np.where(w > 0, np.maximum(0.0, w - (self.u + q)), np.where(w < 0, np.minimum(0.0, w + (self.u - q)), w))
            self.q[:, index] = q + kept - w
            new = kept / self.scale
        self.late[:, index] += (new - old) * self.scales
        self.v[:, index] = new
        self.bias += push
        self.scales += self.scale
        self.bias_sum += self.bias
        self.t += 1
        self.rows += 1

    def go(self, labels: np.ndarray, at: np.ndarray, index: np.ndarray, value: np.ndarray, weights: np.ndarray) -> None:
        """Steps through rows: row k has the entries from at[k] to at[k + 1]."""
        for k in range(len(labels)):
            y = np.full(len(self.v), -1.0)
            if labels[k] < len(y):
                y[labels[k]] = 1.0
            self.step(y, index[at[k] : at[k + 1]], value[at[k] : at[k + 1]], weights[k])

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights at the end, and the sum of those after each step."""
        end, total = self.scale * self.v, self.scales * self.v - self.late
        end[:, -1], total[:, -1] = self.bias, self.bias_sum
        return end, total


class _SmallWalk(_Walk):
    """The same pass on plain floats, for small models."""

    def go(self, labels: np.ndarray, at: np.ndarray, index: np.ndarray, value: np.ndarray, weights: np.ndarray) -> None:
        how, exp, log1p, classes = self.how, math.exp, math.log1p, range(len(self.v))
        alpha, first, l1 = how.alpha, how.first, how.share_of_l1
        v, q, late, bias, bias_sum, loss = (x.tolist() for x in (self.v, self.q, self.late, self.bias, self.bias_sum, self.loss))
        t, u, scale, scales = self.t, self.u, self.scale, self.scales
        at, index, value = at.tolist(), index.tolist(), value.tolist()
        for k, (label, weight) in enumerate(zip(labels.tolist(), weights.tolist(), strict=True)):
            here, x = index[at[k] : at[k + 1]], value[at[k] : at[k + 1]]
            eta = 1.0 / (alpha * (first + t))
            before, scale = scale, scale * max(0.0, 1.0 - (1.0 - l1) * eta * alpha)
            owed = u + l1 * eta * alpha
            small = scale < 1e-9
            for c in classes:
                w, y = v[c], 1.0 if label == c else -1.0
                z = 0.0
                for i, value_ in zip(here, x, strict=True):
                    z += w[i] * value_
                z = y * (before * z + bias[c])
                if z > 18:
                    force = exp(-z)
                    loss[c] += force
                elif z < -18:
                    force = 1.0
                    loss[c] -= z
                else:
                    loss[c] += log1p(exp(-z))
                    force = 1.0 / (exp(z) + 1.0)
                push = weight * eta * force * y
                if small:
                    late[c] = [a + (scale - 1.0) * b * scales for a, b in zip(late[c], w, strict=True)]
                    v[c] = w = [b * scale for b in w]
                now, behind = 1.0 if small else scale, late[c]
                for i, value_ in zip(here, x, strict=True):
                    old = w[i]
                    new = old + push * value_ / now
                    if l1:
                        full, taken = new * now, q[c][i]
                        kept = max(0.0, full - (owed + taken)) if full > 0 else min(0.0, full + (owed - taken)) if full < 0 else full
                        q[c][i] = taken + kept - full
                        new = kept / now
                    behind[i] += (new - old) * scales
                    w[i] = new
                bias[c] += push
                bias_sum[c] += bias[c]
            if small:
                scale = 1.0
            u = owed
            scales += scale
            t += 1
        self.v, self.q, self.late, self.bias, self.bias_sum, self.loss = (np.array(x) for x in (v, q, late, bias, bias_sum, loss))
        self.t, self.u, self.scale, self.scales = t, u, scale, scales
        self.rows += len(labels)


def _epoch(rows: DataFrame, how: Descent, classes: int, weights: np.ndarray, q: np.ndarray, steps: float, u: float, total: int):
    """Weights and penalties after an epoch, averaged by rows, the mean of all iterates, and the mean loss."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, q))
    small = weights.size <= SMALL_MODEL

    def run(batches):
        walk = None
        for b in batches:
            feats = b.column("features")
            at, pairs = feats.offsets.to_numpy(), feats.values
            if walk is None:
                short = small and b.num_rows and at[-1] - at[0] <= SHORT_ROW * b.num_rows
                walk = (_SmallWalk if short else _Walk)(how, *shared.value, steps, u)
            index, value = pairs.field("index").to_numpy(zero_copy_only=False), pairs.field("value").to_numpy(zero_copy_only=False)
            walk.go(b.column("class").to_numpy(), at, index, value, b.column("weight").to_numpy())
        if walk is None or not walk.rows:
            return
        end, sums = walk.sums()
        part = walk.rows / total
        for c in range(classes):
            some = np.flatnonzero((end[c] != 0) | (sums[c] != 0) | (walk.q[c] != 0))
            columns = (end[c, some] * part, sums[c, some] / total, walk.q[c, some] * part)
            lists = [pa.array([some.astype(np.int32).tolist()], pa.list_(pa.int32())), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in columns)]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), *lists, pa.array([walk.loss[c] / total])], names=["class", "index", "w", "mean", "q", "loss"])

    sent = written(rows.mapInArrow(run, _SENT), "descent-epoch")
    each = sent.select("class", F.explode(F.arrays_zip("index", "w", "mean", "q")).alias("z")).groupBy("class", "z.index").agg(*(F.sum(f"z.{c}").alias(c) for c in ("w", "mean", "q")))
    out = [np.zeros_like(weights) for _ in range(3)]
    met = each.toArrow()  # one model
    place = (met.column("class").to_numpy(), met.column("index").to_numpy())
    for x, c in zip(out, ("w", "mean", "q"), strict=True):
        x[place] = met.column(c).to_numpy()
    shared.destroy()
    return (*out, sent.agg(F.sum("loss")).first()[0] or 0.0)


def fit(df: DataFrame, n_features: int, how: Descent | None = None, label: str = "label", features: str = "features", key: str = "row_id", weight: str | None = None) -> LinearModel:
    """A model of ``label`` from sparse ``features``, an array of (index, value) with indexes below ``n_features``.

    Rows go through in order of a hash of ``key``, the epoch and the seed, so that runs repeat; rows with a null label or null features are
    left out. Two classes are two rows of weights that mirror each other. It ends after ``epochs``, or once ``n_iter_no_change`` of them
    in a row don't lower the mean loss by ``tol``. More partitions than one change the result: see the tests for by how much.
    """
    how = how or Descent()
    rows = df.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    classes = sorted(r[0] for r in rows.select(label).distinct().collect())  # classes, each of which has weights here
    if not classes:
        raise ValueError("no labelled row")
    if len(classes) * (n_features + 1) > MOST_WEIGHTS:
        raise ValueError(f"a model of {len(classes)} classes and {n_features} features is too large to hold; hash the features to fewer")
    number = F.array_position(F.array(*map(F.lit, classes)), F.col(label)).cast("int") - 1
    plain = F.transform(features, lambda p: F.struct(p["index"].cast("int").alias("index"), p["value"].cast("double").alias("value")))
    chosen = rows.select(F.col(key).alias("key"), number.alias("class"), plain.alias("features"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))
    dealt = written(chosen, "descent-rows")
    total = dealt.count()
    parts = how.partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    machines = 1 if len(classes) == 2 else len(classes)  # the second of two classes has the first one's weights with the other sign
    weights, q = np.zeros((machines, n_features + 1)), np.zeros((machines, n_features + 1))
    mean, steps, u, best, worse, losses = np.zeros_like(weights), 0.0, 0.0, np.inf, 0, []
    for epoch in range(how.epochs):
        rows = dealt.repartition(parts, "key").sortWithinPartitions(F.xxhash64("key", F.lit(how.seed + epoch)), "key")
        weights, ahead, q, loss = _epoch(rows, how, machines, weights, q, steps, u, total)
        mean += (ahead - mean) / (epoch + 1)
        for t in range(max(1, round(total / parts))) if how.share_of_l1 else ():
            u += how.share_of_l1 / (how.first + steps + t)
        steps += total / parts
        loss *= len(classes) / machines
        losses.append(loss)
        worse = worse + 1 if loss > best - how.tol else 0
        best = min(best, loss)
        if worse >= how.n_iter_no_change:
            break
    found = mean if how.average else weights
    return LinearModel(classes, np.concatenate([found, -found]) if machines < len(classes) else found, losses)


def predicted(df: DataFrame, model: LinearModel, features: str = "features") -> DataFrame:
    """``df`` with prediction (the class of the largest decision, the first of equal ones; null without features) and decisions by class."""
    from pyspark.sql import types as T

    shared = df.sparkSession.sparkContext.broadcast(model.weights)
    own = df.columns

    def run(batches):
        for b in batches:
            pairs, w, n = b.column("_entries"), shared.value, b.num_rows
            at, inner = pairs.offsets.to_numpy(), pairs.values
            index, value = (inner.field(f).to_numpy(zero_copy_only=False)[at[0] : at[-1]] for f in ("index", "value"))
            row = np.repeat(np.arange(n), np.diff(at))
            out = np.stack([np.bincount(row, w[c, index] * value, n) + w[c, -1] for c in range(len(w))], axis=1)
            places = pa.array(np.arange(n + 1, dtype=np.int32) * len(w))
            lists = pa.ListArray.from_arrays(places, pa.array(out.ravel()), mask=pairs.is_null())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), lists], names=[*own, "_decisions"])

    schema = T.StructType([*df.schema.fields, T.StructField("_decisions", T.ArrayType(T.DoubleType()))])
    plain = F.transform(features, lambda p: F.struct(p["index"].cast("int").alias("index"), p["value"].cast("double").alias("value")))
    scored = df.withColumn("_entries", plain).mapInArrow(run, schema)
    best = F.array_position("_decisions", F.array_max("_decisions")).cast("int")
    classes = F.array(*map(F.lit, model.classes))
    return scored.withColumns({"prediction": F.get(classes, best - 1), "decisions": F.map_from_arrays(classes, F.col("_decisions"))}).drop("_decisions")
