"""From submissions to rows of training data, and from these to a fitted classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlint.functions import values as V
from emberlint.functions.diagnostics import error_tokens
from emberlint.operators.contexts import with_context_columns
from emberlint.operators.labeling import apply_labels
from emberlint.operators.rows import one_to_one, override


def kept_submissions(df: DataFrame) -> DataFrame:
    """Rows whose diagnostic has a known code, with error_code and is_in_train."""
    kept = df.where(F.coalesce(F.col("error_text").rlike("|".join(V.ERROR_CODES)), F.lit(False)))
    return kept.withColumn("error_code", F.substring("error_text", 1, 5)).withColumn("is_in_train", F.lit(1))


def labelled(df: DataFrame, not_in_train: list[int] = (), overrides: dict[str, list[int]] | None = None) -> DataFrame:
    """Labels by functions, then by hand."""
    out = override(apply_labels(df), "row_id", list(not_in_train), "is_in_train", 0)
    for label, ids in (overrides or {}).items():
        out = override(out, "row_id", ids, "label_code", label)
    return out


def with_features(df: DataFrame, contexts: DataFrame) -> DataFrame:
    """Joined one to one with contexts; tokens and numbers as JSON."""
    joined = with_context_columns(one_to_one(df, contexts, "row_id"))
    return joined.withColumn("error_text_tokens", F.to_json(error_tokens(F.col("error_text"))))


def training_rows(df: DataFrame, codes: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Rows with the id of their label; labels that their code doesn't have are dropped. Both dimensions are of fixed size."""
    known = df.join(F.broadcast(codes), "error_code")
    # One key of both parts: a key of its own for the label would be tested for null below the labels, which doubles their work.
    named = recommendations.where("recommendation_code is not null").select("recommendation_id", F.struct("recommendation_code", "error_code_id").alias("_of"))
    match = F.struct(known["label_code"].alias("recommendation_code"), known["error_code_id"]) == named["_of"]
    names = ["error_text", "error_text_tokens", "error_code", "error_line", "source_code", "ctx_tokens", "ctx_numeric", "is_in_train"]
    joined = known.join(F.broadcast(named), match)
    return joined.select(F.col("recommendation_id").alias("label"), *(known[n] for n in names if n in known.columns))


def build(submissions: DataFrame, contexts: DataFrame, codes: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Training rows of submissions.

    Rows move by their key before anything is worked out, in twice the parts that the session names (Spark drops a
    step into just as many as a join gave): a row takes far more time than its size lets Spark expect, which else deals few large parts. The join with contexts keeps these parts, and labels come last, since
    Python's step forgets how rows are dealt, and a join behind it would move them again.
    """
    parts = 2 * int(submissions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = kept_submissions(submissions).repartition(parts, "row_id")
    return training_rows(labelled(with_features(kept, contexts)), codes, recommendations)
