"""Measures of classifiers as aggregates of (truth, predicted) and of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _share(a, b):
    return F.when(b == 0, 0.0).otherwise(a / b)


def class_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, hits, n_predicted, support) by one aggregate over pairs."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(True).alias("true"), "t", "p", "n"), F.struct(F.col("p").alias("label"), F.lit(False).alias("true"), "t", "p", "n"))).alias("s")).select("s.*")
    return sides.groupBy("label").agg(
        F.sum(F.when(F.col("true") & (F.col("t") == F.col("p")), F.col("n")).otherwise(0)).alias("hits"),
        F.sum(F.when(~F.col("true"), F.col("n")).otherwise(0)).alias("n_predicted"),
        F.sum(F.when(F.col("true"), F.col("n")).otherwise(0)).alias("support"),
    )


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label as text, precision, recall, f1, support), with rows for accuracy, macro and weighted averages; 0 / 0 is 0."""
    counts = class_counts(df, truth, predicted)
    rows = counts.withColumn("precision", _share(F.col("hits"), F.col("n_predicted"))).withColumn("recall", _share(F.col("hits"), F.col("support")))
    rows = rows.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    measures = ("precision", "recall", "f1")
    total = F.sum("support")
    single = rows.select(F.col("label").cast("string").alias("label"), *measures, "support")
    accuracy = rows.agg(*(_share(F.sum("hits"), total).alias(m) for m in measures), total.alias("support")).withColumn("label", F.lit("accuracy"))
    macro = rows.agg(*(F.avg(m).alias(m) for m in measures), total.alias("support")).withColumn("label", F.lit("macro avg"))
    weighted = rows.agg(*(_share(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in measures), total.alias("support")).withColumn("label", F.lit("weighted avg"))
    return single.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def confusion(df: DataFrame, truth: str, predicted: str, normalize: str | None = "true") -> DataFrame:
    """(truth, predicted, n, share) of pairs that occur; shares of the true label, the predicted one, or all."""
    n = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    by = {"true": Window.partitionBy("truth"), "pred": Window.partitionBy("predicted"), "all": Window.partitionBy(F.lit(1))}
    share = F.col("n").cast("double") if normalize is None else F.col("n") / F.sum("n").over(by[normalize])
    return n.withColumn("share", share)


def one_vs_rest(df: DataFrame, row: str, truth: str, scores: str) -> DataFrame:
    """(row, label, score, positive) for each class of a map of scores."""
    return df.select(row, truth, F.explode(scores).alias("label", "score")).select(row, "label", "score", (F.col("label") == F.col(truth).cast("string")).alias("positive"))


#: Ranges that distinct scores are dealt to for running sums.
RANGES = 256


def _running(at: DataFrame, keys: list[str], score: str, columns: list[str]) -> DataFrame:
    """Adds, for each of ``columns``, its sum over rows of lesser scores (``_below_x``) and over all (``_all_x``), by ``keys``.

    Scores are dealt to ranges between quantiles of theirs, of which the driver gets a bounded number; sums run within a range
    and start from the sums of the ranges below, so no task orders all scores. ``at`` has one row for each score.
    """
    bounds = sorted(set(at.where(F.col(score).isNotNull()).approxQuantile(score, [k / RANGES for k in range(1, RANGES)], 0.25 / RANGES)))
    ranged = at.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda x: x < F.col(score))) if bounds else F.lit(0))
    sums = ranged.groupBy(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_of")).agg(*(F.sum(c).alias(f"_s_{c}") for c in columns))
    whole = Window.partitionBy(*(f"_{k}" for k in keys)) if keys else Window.partitionBy(F.lit(1))  # at most RANGES rows for each key
    upto = whole.orderBy("_of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select(*(f"_{k}" for k in keys), "_of", *(x for c in columns for x in ((F.sum(f"_s_{c}").over(upto) - F.col(f"_s_{c}")).alias(f"_before_{c}"), F.sum(f"_s_{c}").over(whole).alias(f"_all_{c}"))))
    within = Window.partitionBy(*keys, "_range").orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = ranged.withColumns({f"_in_{c}": F.sum(c).over(within) - F.col(c) for c in columns})
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = ranged.join(sums, same)
    return out.withColumns({f"_below_{c}": F.col(f"_in_{c}") + F.col(f"_before_{c}") for c in columns})


def roc_curve(df: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """(threshold, fpr, tpr) at each distinct score, from sums over one row a distinct score."""
    at = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    above = lambda c: _share(F.col(f"_all_{c}") - F.col(f"_below_{c}"), F.col(f"_all_{c}"))
    return _running(at, [], "threshold", ["p", "n"]).select("threshold", above("n").alias("fpr"), above("p").alias("tpr"))


def roc_auc(df: DataFrame, by: str | None = None, score: str = "score", positive: str = "positive") -> DataFrame:
    """(by, auc, support): area under the curve by rank sums over distinct scores, equal scores counting half."""
    keys = [by] if by else []
    at = df.groupBy(*keys, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    summed = _running(at, keys, score, ["n"]).withColumn("won", F.col("p") * (F.col("_below_n") + F.col("n") / 2))
    return summed.groupBy(*keys).agg(_share(F.sum("won"), F.sum("p") * F.sum("n")).alias("auc"), F.sum("p").alias("support"))


def averaged_auc(by_class: DataFrame) -> DataFrame:
    """(macro, weighted) from ``roc_auc`` by class."""
    return by_class.agg(F.avg("auc").alias("macro"), _share(F.sum(F.col("auc") * F.col("support")), F.sum("support")).alias("weighted"))
