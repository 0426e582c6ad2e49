"""Recommendations over a stream and windowed counts; an addition, as the batch plans run over streams unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlint.functions.text import code_hash
from emberlint.operators.rows import first_per_group
from emberlint.plans.serving import explained


def read_submissions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def recommended(stream: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Predicted labels of a stream with their texts: a stream-static join with a dimension of fixed size."""
    return explained(stream, recommendations)


def windowed_counts(stream: DataFrame, at: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, by, n) for tumbling windows; rows later than the watermark are left out. Works on batches as well."""
    marked = stream.withWatermark(at, late) if stream.isStreaming else stream
    return marked.groupBy(F.window(at, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def first_programs(stream: DataFrame, at: str, keep: str = "1 day", code: str = "source_code") -> DataFrame:
    """Rows with hash whose program wasn't seen within ``keep`` before; null programs are left out.

    The state is a row for each hash and goes when the watermark passes ``keep`` after it, so it doesn't grow with the stream's age; a
    query that starts again from its checkpoint remembers what it gave. On a batch: the first row of each program by ``at``.
    """
    hashed = stream.where(F.col(code).isNotNull()).withColumn("hash", code_hash(F.col(code)))
    if stream.isStreaming:
        return hashed.withWatermark(at, keep).dropDuplicatesWithinWatermark(["hash"])
    return first_per_group(hashed, ["hash"], [at])
