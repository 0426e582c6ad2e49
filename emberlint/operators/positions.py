"""Positions of rows in an order: a table kept by ranges whose sizes are known, so that a slice opens the ranges it falls in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranges of an index, at most: each has one row in the list of sizes, which the driver reads.
MOST_RANGES = 100_000


@dataclass(frozen=True)
class OrderIndex:
    """A table below ``path`` in order of ``key``: a folder for each range of keys, in which rows know their place, and the ranges' sizes."""

    spark: SparkSession
    path: str
    key: tuple[str, ...]

    @classmethod
    def build(cls, df: DataFrame, path: str, *key: str, ranges: int = 200) -> OrderIndex:
        """Write ``df`` in order of the columns ``key`` (nulls first) to about ``ranges`` ranges; what was at ``path`` is replaced.

        Rows with equal keys are one range's, in an order that the written table fixes. One shuffle, and no task holds more than its range.
        """
        if not 0 < ranges <= MOST_RANGES:
            raise ValueError(f"between 1 and {MOST_RANGES} ranges")
        ordered = df.repartitionByRange(ranges, *key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id())
        placed = ordered.withColumns({"_range": F.shiftright("_at", 33).cast("int"), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")
        placed.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
        spark = df.sparkSession
        sizes = spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy("_range").agg(F.count("*").alias("n"))
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")
        return cls(spark, path, key)

    @property
    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def starts(self) -> list[tuple[int, int, int]]:
        """(range, position of its first row, rows), in order."""
        out, before = [], 0
        for r, n in sorted((r[0], r[1]) for r in self.spark.read.schema("_range int, n long").parquet(f"{self.path}/sizes").collect()):
            out.append((r, before, n))
            before += n
        return out

    def slice(self, start: int, end: int) -> DataFrame:
        """Rows at positions ``start`` to ``end`` (exclusive), with ``position``. Only folders of ranges that hold some are listed and read."""
        near: Column = F.lit(False)
        position = F.lit(None).cast("long")
        for r, before, n in self.starts():
            if before < end and before + n > start:
                here = F.col("_range") == r
                near = near | (here & (F.col("_place") >= max(0, start - before)) & (F.col("_place") < end - before))
                position = F.when(here, F.col("_place") + before).otherwise(position)
        return self._rows.where(near).withColumn("position", position).drop("_range", "_place")

    def at(self, positions: list[int]) -> DataFrame:
        """Rows at the listed positions; those that the table doesn't have are left out."""
        out = self.slice(0, 0)
        for p in sorted(set(positions)):
            out = out.unionByName(self.slice(p, p + 1))
        return out

    def batches(self, size: int) -> DataFrame:
        """All rows with ``position`` and ``batch``, consecutive batches of ``size`` rows; no shuffle, as positions are known."""
        starts = self.spark.createDataFrame([(r, before) for r, before, _ in self.starts()], "_range int, _before long")  # a row for each range
        rows = self._rows.join(F.broadcast(starts), "_range").withColumn("position", F.col("_place") + F.col("_before"))
        return rows.withColumn("batch", F.floor(F.col("position") / size).cast("long")).drop("_range", "_place", "_before")
