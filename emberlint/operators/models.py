"""Classifiers of pyspark.ml with balanced weights, tuning, and model folders."""

from __future__ import annotations

import json
import platform
import random
from collections.abc import Callable
from datetime import datetime, timezone
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds weight: rows by classes times the class's rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))  # one row
    return df.join(F.broadcast(counts.join(F.broadcast(total), F.lit(True))), label).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def estimators() -> dict[str, Callable]:
    """Estimators by name; no other path is imported."""
    from pyspark.ml import classification as M

    return {
        "logistic": lambda **p: M.LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", **p),
        "forest": lambda **p: M.RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", **p),
        "linear_svc": lambda **p: M.OneVsRest(classifier=M.LinearSVC(**p), featuresCol="features", labelCol="label", weightCol="weight"),
    }


def fitted(df: DataFrame, name: str, params: dict):
    """A model, without its training summary: that holds the session, which need not go to executors with the model."""
    model = estimators()[name](**params).fit(df)
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(df.sparkSession.sparkContext._jvm.scala.Option.empty())
    return model


def grid(params: dict[str, list]) -> list[dict]:
    """All combinations; one empty one without parameters."""
    return [dict(zip(params, values, strict=True)) for values in product(*params.values())]


def accuracy(df: DataFrame) -> float:
    return df.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0] or 0.0


def macro_f1(df: DataFrame) -> float:
    """Mean of the classes' harmonic means of precision and recall."""
    from emberlint.operators.evaluation import classification_report

    found = classification_report(df, "label", "prediction").where("label = 'macro avg'").first()
    return found["f1"] or 0.0 if found else 0.0


SCORERS = {"accuracy": accuracy, "f1_macro": macro_f1}


def tuned(
    df: DataFrame, name: str, params: dict[str, list], method: str = "grid", folds: int = 3, factor: int = 3, seed: int = 42, scorer: str = "accuracy", n_iter: int = 10, resource: str = "n_samples"
) -> tuple[object, dict]:
    """(model on all rows, parameters): by cross-validated score, of all candidates, of ``n_iter`` drawn ones, or by halving.

    Methods: ``none``, ``grid``, ``random``, ``halving_grid``, ``halving_random``. Halving scores candidates on a share of the rows
    that grows as their number falls; with a ``resource`` other than rows, on values of that parameter up to the grid's largest.
    Unknown methods or scorers, several scorers for halving, and a resource that the grid lacks raise.
    """
    if method not in ("none", "grid", "random", "halving_grid", "halving_random"):
        raise ValueError(f"unknown method: {method}")
    if not isinstance(scorer, str):
        raise ValueError("one scorer is needed")
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer: {scorer}")
    halving = method.startswith("halving")
    most = None
    if halving and resource != "n_samples":
        if resource not in params:
            raise ValueError(f"no largest value of {resource} in the grid")
        most = max(params[resource])
        params = {k: v for k, v in params.items() if k != resource}
    candidates = grid(params)
    if method.endswith("random"):
        candidates = random.Random(seed).sample(candidates, min(n_iter, len(candidates)))
    if method == "none":
        return fitted(df, name, candidates[0]), candidates[0]
    dealt = df.withColumn("_fold", F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(folds))).withColumn("_draw", F.pmod(F.xxhash64("row_id", F.lit(seed + 1)), F.lit(1 << 20)) / (1 << 20))

    def score(p: dict, share: float) -> float:
        part = dealt
        if most is not None:
            p = {**p, resource: type(most)(max(1, most * share))}
        elif share < 1:
            part = dealt.where(F.col("_draw") < share)
        return sum(SCORERS[scorer](fitted(part.where(F.col("_fold") != k), name, p).transform(part.where(F.col("_fold") == k))) for k in range(folds)) / folds

    if halving:
        rounds = 0
        while factor**rounds < len(candidates):
            rounds += 1
        for k in range(rounds, 0, -1):
            ranked = sorted(candidates, key=lambda p: -score(p, factor**-k))
            candidates = ranked[: max(1, len(ranked) // factor)]
    best = max(candidates, key=lambda p: score(p, 1.0)) if len(candidates) > 1 else candidates[0]
    best = best if most is None else {**best, resource: most}
    return fitted(df, name, best), best


def out_of_fold(df: DataFrame, name: str, params: dict, fold: str = "fold", k: int = 5) -> DataFrame:
    """Predictions for each fold by a model of the others."""
    out = None
    for i in range(k):
        part = fitted(df.where(F.col(fold) != i), name, params).transform(df.where(F.col(fold) == i))
        out = part if out is None else out.unionByName(part)
    return out


def as_vectors(entries: DataFrame, row: str, terms: DataFrame | None, size: int, rows: DataFrame | None = None) -> DataFrame:
    """(row, features): sparse vectors from long entries (row, term, value) and (term, index), built from Arrow batches.

    Without ``terms`` entries have their index already. Rows of ``rows`` (row) without entries are vectors of zeros.
    """
    import pyarrow as pa
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T

    pairs = F.array_sort(F.collect_list(F.struct("index", "value")))
    grouped = (entries if terms is None else entries.join(terms, "term")).groupBy(row).agg(pairs.alias("_pairs"))
    if rows is not None:
        grouped = rows.select(row).distinct().join(grouped, row, "left")
        grouped = grouped.withColumn("_pairs", F.coalesce("_pairs", F.array().cast(grouped.schema["_pairs"].dataType)))
    grouped = grouped.select(row, F.transform("_pairs", lambda p: p["index"].cast("int")).alias("_at"), F.transform("_pairs", lambda p: p["value"].cast("double")).alias("_values"))
    schema = T.StructType([grouped.schema[row], T.StructField("features", VectorUDT())])

    def run(batches):
        for b in batches:
            n = b.num_rows
            parts = [pa.array([0] * n, pa.int8()), pa.array([size] * n, pa.int32()), b.column("_at"), b.column("_values")]
            yield pa.RecordBatch.from_arrays([b.column(row), pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])], names=[row, "features"])

    return grouped.mapInArrow(run, schema)


def term_index(entries: DataFrame, path: str) -> DataFrame:
    """(term, index) in order of terms, from 0.

    Terms are written to ``path`` (a folder that the cluster shares; what was there is replaced) by ranges, then each range starts where the terms before it
    end; of the ranges only their numbers of terms are ordered.
    """
    spark = entries.sparkSession
    ordered = entries.select("term").where("term is not null").distinct().repartitionByRange("term").sortWithinPartitions("term")
    ordered.select("term", F.spark_partition_id().alias("_part")).write.mode("overwrite").parquet(path)
    terms = spark.read.schema("term string, _part int").parquet(path)
    counts = terms.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")  # one row a range
    place = F.row_number().over(Window.partitionBy("_part").orderBy("term")) - 1
    starts = F.broadcast(counts.select("_part", before.alias("_before")))  # one row a range
    return terms.withColumn("_place", place).join(starts, "_part").select("term", (F.col("_place") + F.col("_before")).cast("int").alias("index"))


def save_bundle(model, path: str, spark: SparkSession, **meta) -> None:
    """A model's folder and its description as a JSON line beside it."""
    model.write().overwrite().save(f"{path}/model")
    record = {"created_at": datetime.now(timezone.utc).isoformat(), "python": platform.python_version(), "spark": spark.version, "kind": f"{type(model).__module__}.{type(model).__name__}", **meta}
    spark.createDataFrame([(json.dumps(record, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_bundle(path: str, spark: SparkSession, strict: bool = False):
    """(model, description). Another version of Spark warns, or raises with ``strict``."""
    import warnings

    from pyspark.ml.util import DefaultParamsReader

    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta["spark"] != spark.version:
        said = f"the model was made with Spark {meta['spark']}, this is {spark.version}"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    return DefaultParamsReader.loadParamsInstance(f"{path}/model", spark.sparkContext), meta
