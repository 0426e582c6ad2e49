"""Slices, updates, checks and lookups on rows that have a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positional_slice(df: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """Rows start to end (exclusive) in order of ``key``."""
    return df.orderBy(key).offset(start).limit(end - start)


def with_missing(df: DataFrame, name: str, kind: str) -> DataFrame:
    """A column of nulls, if there is none of that name."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def without(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``df`` without a column, and that column alone; a column that isn't there raises."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    return df.drop(column), df.select(column)


def lookup(x: Column, table: dict[str, str]) -> Column:
    """The value of a small table, null for keys it doesn't have."""
    pairs = F.create_map(*(F.lit(v) for kv in table.items() for v in kv))
    return F.try_element_at(pairs, x)


def override(df: DataFrame, key: str, ids: list[int], column: str, value) -> DataFrame:
    """``column`` set to ``value`` where ``key`` is listed."""
    return df.withColumn(column, F.when(F.col(key).isin(ids), F.lit(value)).otherwise(F.col(column)))


def updated(df: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` from ``new`` where it has the key and a value, else as it was."""
    if key not in new.columns:
        raise ValueError(f"no column {key}")
    fresh = new.select(key, F.col(column).alias("_new"))
    return df.join(fresh, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def unknown_keys(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key ``df`` doesn't have."""
    return new.join(df, key, "left_anti")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key``; fails when it runs if a key repeats on either side."""

    def guarded(df: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(key))
        failed = F.raise_error(F.concat(F.lit(f"{side}: repeated {key} "), F.col(key).cast("string"))).cast("boolean")
        return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, failed).otherwise(F.lit(True))).drop("_n")

    return guarded(left, "left").join(guarded(right, "right"), key)


def merge_contexts(*frames: DataFrame) -> DataFrame:
    """Bag union of (row_id, ctx); fails when it runs on a missing field or a repeated row_id."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    bad = F.when(F.col("row_id").isNull() | F.col("ctx").isNull(), "a field is missing").when(F.count("*").over(Window.partitionBy("row_id")) > 1, "repeated row_id")
    return out.withColumn("_bad", bad).where(F.when(F.col("_bad").isNotNull(), F.raise_error(F.col("_bad")).cast("boolean")).otherwise(F.lit(True))).drop("_bad")


def first_per_group(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def batch_number(df: DataFrame, key: str, size: int) -> DataFrame:
    """Consecutive batches of a dense key, for stages that work batch by batch."""
    return df.withColumn("batch", F.floor(F.col(key) / size).cast("long"))


def _ranked(df: DataFrame, by: str, key: str, seed: int) -> DataFrame:
    """Adds _rank, from 1, in order of a hash of key and seed among rows of one ``by``, and _all, their number.

    Hashes fall into 65 536 ranges by their first digits. Rows are ordered within a range, and ranges are counted before,
    so the largest ``by`` is dealt to as many tasks as it needs. Nulls are a value of their own.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))).withColumn("_range", F.substring("_hash", 1, 4))
    counts = hashed.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_of")).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_by")
    before = F.sum("_n").over(whole.orderBy("_of").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    counts = counts.select("_by", "_of", before.alias("_before"), F.sum("_n").over(whole).alias("_all"))
    place = F.row_number().over(Window.partitionBy(by, "_range").orderBy("_hash", key))
    joined = hashed.withColumn("_place", place).join(counts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_of")))
    return joined.withColumn("_rank", F.col("_place") + F.col("_before")).drop("_hash", "_range", "_by", "_of", "_before", "_place")


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds is_test: of each label that share of its rows (rounded), those first in order of a hash of key and seed."""
    return _ranked(df, label, key, seed).withColumn("is_test", F.col("_rank") <= F.round(F.col("_all") * test_share)).drop("_rank", "_all")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold, 0 to k - 1, so that each label is spread evenly."""
    return _ranked(df, label, key, seed).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_all")


def plain_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold by a hash alone: folds of nearly one size without ordering all rows."""
    h = F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", (h % k).cast("int"))


def chosen(values: list[str], key: Column, seed: int) -> Column:
    """One of ``values`` by a hash of key and seed."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(len(values))) + 1).cast("int"))


def generated_samples(df: DataFrame, pattern: str, placeholders: dict[str, list[str]], key: str = "id", seed: int = 42) -> DataFrame:
    """Programs from a pattern for each row of ``df``, repeated ones left out by their hash."""
    from emberlint.functions.text import code_hash, fill_template

    picks = {name: chosen(values, F.col(key), seed + k) for k, (name, values) in enumerate(placeholders.items())}
    made = df.select(key, fill_template(F.lit(pattern), picks).alias("source_code"))
    return made.withColumn("hash", code_hash(F.col("source_code"))).dropDuplicates(["hash"])


def kept_samples(made: DataFrame, compile_: Callable[[str], bytes], code: str, most: int) -> DataFrame:
    """Up to ``most`` generated programs (id, source_code, hash), by id, whose compilation reports ``code``; adds error_text, error_line."""
    from emberlint.functions.diagnostics import has_error_code
    from emberlint.operators.boundary import compiled

    key = made.columns[0]
    return compiled(made, compile_).where(has_error_code(F.col("error_text"), code)).orderBy(key).limit(most)


def insertable(new: DataFrame, old: DataFrame, unique: list[str], required: list[str]) -> DataFrame:
    """Rows of ``new`` that keep the constraints: required columns set, unique ones not there yet."""
    for c in required:
        new = new.where(F.col(c).isNotNull())
    return new.dropDuplicates(unique).join(old, unique, "left_anti")


def counters(df: DataFrame, kept: Column) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))
