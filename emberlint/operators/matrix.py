"""Feature matrices in long form (row, term, value): n-grams, counts, weights, scaling, nearest neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlint.sources.tables import written


def ngrams(tokens: Column, least: int, most: int) -> Column:
    """All runs of least to most tokens, joined by spaces, shorter ones first."""
    empty = F.array().cast("array<string>")

    def of(n: Column) -> Column:
        last = F.size(tokens) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))).otherwise(empty)

    return F.flatten(F.transform(F.sequence(F.lit(least), F.lit(most)), of))


def term_counts(df: DataFrame, row: str, tokens: Column) -> DataFrame:
    """(row, term, value): how often each token is in each row.

    Rows move once by their key, before their tokens are taken apart, so that those of a key are counted where they are; their terms don't move.
    """
    return df.repartition(row).select(row, F.explode(tokens).alias("term")).groupBy(row, "term").agg(F.count("*").cast("double").alias("value"))


def hashed_counts(df: DataFrame, row: str, tokens: Column, buckets: int = 1 << 20, signed: bool = False) -> DataFrame:
    """As ``term_counts``, terms being hash buckets; with ``signed`` half of the terms count negative."""
    terms = df.repartition(row).select(row, F.explode(tokens).alias("t"))
    sign = F.when(F.lit(signed) & (F.xxhash64("t", F.lit(1)) < 0), -1.0).otherwise(1.0)
    return terms.select(row, F.pmod(F.xxhash64("t"), F.lit(buckets)).alias("term"), sign.alias("v")).groupBy(row, "term").agg(F.sum("v").alias("value"))


def _with_totals(entries: DataFrame, **totals: Column) -> DataFrame:
    """Adds aggregates over each term: partial sums, then a join that adaptive execution can split for a term of most rows."""
    by_term = entries.groupBy(F.col("term").alias("_term")).agg(*(x.alias(name) for name, x in totals.items()))
    return entries.join(by_term, F.col("term").eqNullSafe(F.col("_term"))).drop("_term")


def tfidf(counts: DataFrame, row: str, rows: int | Column, sublinear: bool = True, smooth: bool = True) -> DataFrame:
    """Weights 1 + ln(tf) times ln((1 + N) / (1 + df)) + 1, rows scaled to length 1.

    Terms with their numbers of rows are written first: as Spark then knows their size, it sends them to the counts while they are few, and joins by shuffles otherwise.
    """
    tf = 1 + F.log("value") if sublinear else F.col("value")
    plus = 1 if smooth else 0
    n = F.lit(rows) if isinstance(rows, int) else rows
    terms = written(counts.groupBy(F.col("term").alias("_term")).agg(F.count("*").alias("_df")), "terms")
    known = counts.join(terms, F.col("term").eqNullSafe(F.col("_term"))).drop("_term")
    weighed = known.withColumn("w", tf * (F.log((n + plus) / (F.col("_df") + plus)) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(row)))
    return weighed.select(row, "term", (F.col("w") / norm).alias("value"))


def max_abs_scaled(entries: DataFrame) -> DataFrame:
    """Values by the largest absolute value of their term."""
    top = F.col("_top")
    known = _with_totals(entries, _top=F.max(F.abs("value")))
    return known.withColumn("value", F.when(top == 0, F.col("value")).otherwise(F.col("value") / top)).drop("_top")


def dictionary_entries(df: DataFrame, row: str, numbers: Column) -> DataFrame:
    """(row, term, value) of a map; absent terms are 0 and not stored."""
    return df.select(row, F.explode(numbers).alias("term", "value"))


def standard_scaled(entries: DataFrame, rows: int | Column) -> DataFrame:
    """Values by their term's population deviation over all rows, absent ones being 0; terms without deviation stay."""
    n = F.lit(rows).cast("double") if isinstance(rows, int) else rows
    known = _with_totals(entries, _sum=F.sum("value"), _squares=F.sum(F.col("value") * F.col("value")))
    mean = F.col("_sum") / n
    deviation = F.sqrt(F.greatest(F.col("_squares") / n - mean * mean, F.lit(0.0)))
    return known.withColumn("value", F.when(deviation > 1e-12, F.col("value") / deviation).otherwise(F.col("value"))).drop("_sum", "_squares")


def assembled(**blocks: DataFrame) -> DataFrame:
    """Blocks of one matrix, each term behind its block's name."""
    parts = [b.withColumn("term", F.concat(F.lit(f"{name}:"), F.col("term").cast("string"))) for name, b in blocks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _closer(best: tuple | None, ids: np.ndarray, d: np.ndarray, k: int) -> tuple:
    """The k nearest for each query, of those so far (distances, ids) and of new rows ``ids`` at distances ``d`` (query by row)."""
    if best is not None:
        ids = np.concatenate([best[1], np.broadcast_to(ids, d.shape)], axis=1)
        d = np.concatenate([best[0], d], axis=1)
    else:
        ids = np.broadcast_to(ids, d.shape)
    order = np.lexsort((ids, d), axis=-1)[:, :k]
    return np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block_bytes: int = 32 << 20) -> DataFrame:
    """(query, key, distance): the k rows of least cosine distance to each query, ties by key; a query isn't its own neighbour.

    Queries, of a stated size, go to the executors in blocks of at most ``block_bytes``, each held against all rows in one pass;
    a task keeps its k best rows for each query, so k rows a query and task are shuffled, whatever the number of rows.
    Null vectors don't take part.
    """
    spark = rows.sparkSession
    asked = queries.select(F.col(key).alias("query"), vector).where(F.col(vector).isNotNull())
    held, out = [], None

    def search(part: list) -> DataFrame:
        ids = np.array([r["query"] for r in part], np.int64)
        q = np.array([r[vector] for r in part], np.float64)
        sent = spark.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) if len(q) else q))

        def run(batches):
            names, unit = sent.value
            best: list = [None] * (-(-len(names) // 512))
            for pdf in batches:
                pdf = pdf[pdf[vector].notna()]
                for at in range(0, len(pdf), 1024):
                    some = pdf.iloc[at : at + 1024]
                    x, its = np.array(some[vector].tolist(), np.float64), some[key].to_numpy()
                    x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
                    for b in range(len(best)):
                        mine = names[b * 512 : b * 512 + 512]
                        d = (1 - unit[b * 512 : b * 512 + 512] @ x).round(9)
                        d[mine[:, None] == its] = np.inf
                        best[b] = _closer(best[b], its, d, k)
            for b, got in enumerate(best):
                if got is not None:
                    there = np.isfinite(got[0])
                    mine = np.repeat(names[b * 512 : b * 512 + 512], got[0].shape[1]).reshape(got[0].shape)
                    yield pd.DataFrame({"query": mine[there], key: got[1][there], "distance": got[0][there]})

        return rows.select(key, vector).mapInPandas(run, f"query long, {key} long, distance double")

    size = 0
    for r in asked.toLocalIterator():
        held.append(r)
        size += 8 * len(r[vector]) + 64
        if size >= block_bytes:
            out, held, size = (search(held) if out is None else out.unionByName(search(held))), [], 0
    if held or out is None:
        out = search(held) if out is None else out.unionByName(search(held)) if held else out
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def voted(neighbours: DataFrame, labels: DataFrame, key: str, label: str, weights: str = "distance") -> DataFrame:
    """(query, label): the label of most weight among neighbours, of equal ones the least; at distance 0 only such neighbours count."""
    near = neighbours.join(labels.select(key, label), key)
    exact = F.max(F.when(F.col("distance") <= 0, 1).otherwise(0)).over(Window.partitionBy("query"))
    weight = F.lit(1.0)
    if weights == "distance":
        weight = F.when(exact == 1, F.when(F.col("distance") <= 0, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    votes = near.withColumn("w", weight).groupBy("query", label).agg(F.round(F.sum("w"), 9).alias("votes"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("votes"), label))
    return votes.withColumn("rank", rank).where("rank = 1").select("query", label)
