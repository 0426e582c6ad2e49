"""From rows of training data to a fitted classifier with its reports, and predictions by a saved one.

Rows have row_id, error_text_tokens, ctx_tokens (JSON lists of texts) and ctx_numeric (a JSON object of numbers), and a label to
train on. Features are fitted on the rows to train on alone: a table of terms with their places and weights, which is saved with
the model and joined to rows to predict. Rows without any feature, nulls included, are vectors of zeros.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlint.functions.text import once
from emberlint.operators import evaluation as E
from emberlint.operators import matrix as M
from emberlint.operators import models
from emberlint.operators import rows as R
from emberlint.plans.serving import explained
from emberlint.sources.tables import written

#: Runs of tokens that are terms, by block.
NGRAMS = {"ctx": (1, 3), "error": (1, 4)}
TERMS = "term string, index int, weight double"


def entries(rows: DataFrame) -> DataFrame:
    """(row_id, term, value): counts of n-grams and numbers, each term behind its block's name.

    Rows move once by their key, before they are taken apart; their terms are counted where they are.
    """
    texts = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    said = lambda block, term, value: F.struct(F.concat(F.lit(f"{block}:"), term).alias("term"), value.alias("value"))
    runs = lambda block, c: once(texts(c), lambda tokens: F.transform(M.ngrams(tokens, *NGRAMS[block]), lambda t: said(block, t, F.lit(1.0))))
    numbers = F.transform(F.map_entries(F.from_json("ctx_numeric", "map<string,double>")), lambda e: said("num", e["key"], e["value"]))
    all_ = F.concat(runs("ctx", "ctx_tokens"), runs("error", "error_text_tokens"), F.coalesce(numbers, F.array().cast("array<struct<term:string,value:double>>")))
    return rows.repartition("row_id").select("row_id", F.inline(all_)).where("value is not null").groupBy("row_id", "term").agg(F.sum("value").alias("value"))


def _is_number():
    return F.col("term").startswith("num:")


def fitted_terms(rows: DataFrame, path: str, scale: str = "standard") -> DataFrame:
    """(term, index, weight), written to ``path``: inverse document frequencies, and scales of numbers (``standard`` or ``max_abs``)."""
    if scale not in ("standard", "max_abs"):
        raise ValueError(f"unknown scale: {scale}")
    spark, found, n = rows.sparkSession, entries(rows), rows.count()
    mean = F.sum("value") / n
    deviation = F.sqrt(F.greatest(F.sum(F.col("value") * F.col("value")) / n - mean * mean, F.lit(0.0)))
    size = deviation if scale == "standard" else F.max(F.abs("value"))
    seen = written(found.groupBy("term").agg(F.count("*").alias("_df"), size.alias("_size")), "model-terms")
    weight = F.when(_is_number(), F.when(F.col("_size") > 1e-12, 1 / F.col("_size")).otherwise(1.0)).otherwise(F.log((1 + F.lit(n)) / (1 + F.col("_df"))) + 1)
    places = models.term_index(seen, f"{path}/order")
    seen.withColumn("weight", weight).join(places, "term").select("term", "index", "weight").write.mode("overwrite").parquet(f"{path}/terms")
    return spark.read.schema(TERMS).parquet(f"{path}/terms")


def vectors(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` with features: weighted terms, of each block of texts to length 1; terms that weren't fitted are left out."""
    size = (terms.agg(F.max("index")).first()[0] or 0) + 1
    known = entries(rows).join(terms, "term")
    raw = F.when(_is_number(), F.col("value")).otherwise(1 + F.log("value")) * F.col("weight")
    block = F.substring_index("term", ":", 1)
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("row_id", "_block")))
    lengths = known.withColumn("value", raw).withColumn("_block", block).withColumn("_length", length)
    scaled = lengths.withColumn("value", F.when(_is_number(), F.col("value")).otherwise(F.col("value") / F.col("_length")))
    return rows.join(models.as_vectors(scaled.select("row_id", "index", "value"), "row_id", None, size, rows.select("row_id")), "row_id")


def train_and_evaluate(
    rows: DataFrame, path: str, name: str = "logistic", params: dict[str, list] | None = None, method: str = "none", scorer: str = "accuracy", folds: int = 5, scale: str = "standard", seed: int = 42
) -> dict:
    """Split, fit features, tune, fit, report and save to ``path``: (model, params, dev and test as reports, confusion).

    The report on the rows to train on is of predictions by models of the other folds. Reports are saved as JSON beside the model,
    whose description names its classes and its scores on both parts. Training again to the same path replaces what is there.
    Both parts and both predictions are written, as fits, scores and reports read them many times.
    """
    spark = rows.sparkSession
    split = written(R.stratified_split(rows.withColumn("label", F.col("label").cast("double")), "label", "row_id", seed=seed), "model-split")
    dev, test = split.where("not is_test").drop("is_test"), split.where("is_test").drop("is_test")
    dev = written(R.stratified_folds(dev, "label", "row_id", k=folds, seed=seed), "model-folds")
    terms = fitted_terms(dev, path, scale)
    vectors(dev, terms).select("row_id", "label", "fold", "features").write.mode("overwrite").parquet(f"{path}/dev")
    ready = models.balanced(spark.read.parquet(f"{path}/dev"), "label")
    model, best = models.tuned(ready, name, params or {}, method=method, scorer=scorer, seed=seed)
    told = ["row_id", "label", "prediction"]
    ahead = written(models.out_of_fold(ready, name, best, k=folds).select(told), "model-ahead")
    on_test = written(model.transform(vectors(test, terms)).select(told), "model-on-test")
    out = {"model": model, "params": best, "dev": E.classification_report(ahead, "label", "prediction"), "test": E.classification_report(on_test, "label", "prediction"), "confusion": E.confusion(on_test, "label", "prediction")}
    classes = sorted(r[0] for r in dev.select("label").distinct().collect())
    scores = {part: {s: f(found) for s, f in models.SCORERS.items()} for part, found in (("dev", ahead), ("test", on_test))}
    models.save_bundle(model, path, spark, params=best, name=name, classes=classes, scores=scores, split={"test_share": 0.15, "seed": seed}, scale=scale, stages=["feat", "clf"])
    for part in ("dev", "test", "confusion"):  # a row for each label, or pair of labels
        out[part].select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/report-{part}")
    return out


def predicted(rows: DataFrame, path: str, recommendations: DataFrame, strict: bool = False) -> DataFrame:
    """(row_id, label, recommendation) by the classifier saved in ``path``; a bundle without its parts raises."""
    spark: SparkSession = rows.sparkSession
    model, meta = models.load_bundle(path, spark, strict)
    if missing := {"feat", "clf"} - set(meta.get("stages", ())):
        raise ValueError(f"the bundle lacks {sorted(missing)}")
    found = model.transform(vectors(rows.drop("label"), spark.read.schema(TERMS).parquet(f"{path}/terms")))
    return explained(found.select("row_id", F.col("prediction").cast("int").alias("label")), recommendations)


def report(path: str, spark: SparkSession, part: str = "test") -> list[dict]:
    """A saved report, a dict for each row."""
    return [json.loads(r[0]) for r in spark.read.text(f"{path}/report-{part}").collect()]
