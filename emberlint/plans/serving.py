"""Recommendations for submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_ERROR = "no compile errors"
UNKNOWN = "no recommendation"


def explained(predicted: DataFrame, recommendations: DataFrame, label: str = "label") -> DataFrame:
    """``predicted`` with the text of its label; the dimension is of fixed size."""
    texts = recommendations.select(F.col("recommendation_id").alias(label), "recommendation")
    return predicted.join(F.broadcast(texts), label, "left").withColumn("recommendation", F.coalesce("recommendation", F.lit(UNKNOWN)))


def status(df: DataFrame) -> DataFrame:
    """Adds status: submissions without a diagnostic have no compile errors, as have those whose compiler ran out of time."""
    return df.withColumn("status", F.when(F.col("error_line").isNull(), NO_ERROR).otherwise("error"))


def recommend(submissions: DataFrame, codes: DataFrame, recommendations: DataFrame) -> DataFrame:
    """(row_id, label, recommendation) by the labeling functions: a lazily built plan, also for one row."""
    from emberlint.plans.training import labelled

    rows = labelled(submissions.withColumn("is_in_train", F.lit(1)))
    known = rows.join(F.broadcast(codes), "error_code")
    # One key of both parts: a key of its own for the label would be tested for null below the labels, which doubles their work.
    named = recommendations.where("recommendation_code is not null").select("recommendation_id", F.struct("recommendation_code", "error_code_id").alias("_of"))
    found = known.join(F.broadcast(named), F.struct(known["label_code"].alias("recommendation_code"), known["error_code_id"]) == F.col("_of"))
    return explained(found.select("row_id", F.col("recommendation_id").alias("label")), recommendations)
