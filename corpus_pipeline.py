"""From raw documents to packed sequences: the stages of a training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of ``documents``; where a stage changes texts, n_chars follows. Null
texts pass the filters (nothing speaks against them) and are packed as empty documents; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlint.llm import decontam, neardup, packing, pii, toxicity
from emberlint.llm.common import materialise, table


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of a model fitted on the labelled ones among them; null and empty texts stay, repeated rows go or stay together."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least id; null and empty texts stay, rows that repeat id and text count once."""
    return neardup.keep_first(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that benchmark windows occur in; those that were nothing else go; null and empty texts stay."""
    return _counted(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the names of its kinds; all rows stay, null texts null."""
    return _counted(pii.mask_documents(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences; null and empty texts are one token, repeated rows are each placed."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: The stages' tokens, sketches and fitted weights aren't expressible in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
