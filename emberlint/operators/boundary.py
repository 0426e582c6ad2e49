"""Compilers and parsers outside of Spark: callables that run over partitions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlint.functions.text import first_error
from emberlint.sources.tables import CTX_SCHEMA

TIMEOUT = 7.5


def command_compiler(command: list[str], timeout: float = TIMEOUT) -> Callable[[str], bytes | None]:
    """A callable that compiles a text by a command (the file's name is added): its output, or None when time is up."""

    def run(source: str) -> bytes | None:
        import pathlib
        import subprocess
        import tempfile

        with tempfile.TemporaryDirectory() as folder:
            path = pathlib.Path(folder, "code.cpp")
            path.write_text(source, encoding="utf-8")
            try:
                return subprocess.run([*command, str(path)], stdout=subprocess.PIPE, stderr=subprocess.STDOUT, cwd=folder, timeout=timeout, check=False).stdout
            except subprocess.TimeoutExpired:
                return None

    return run


def compiled(df: DataFrame, compiler: Callable[[str], bytes | None]) -> DataFrame:
    """``df`` with error_text and error_line of source_code's first diagnostic; null when the compiler gave nothing."""
    schema = T.StructType([*df.schema.fields, T.StructField("output", T.BinaryType())])

    def run(batches):
        for pdf in batches:
            yield pdf.assign(output=pd.Series([compiler(s) if s is not None else None for s in pdf["source_code"]], index=pdf.index, dtype=object))

    from emberlint.functions.text import decode_output

    said, line = first_error(decode_output(F.col("output")))
    return df.mapInPandas(run, schema).withColumns({"error_text": said, "error_line": line}).drop("output")


def with_contexts(df: DataFrame, extract: Callable[[str, int, bool], dict], with_macros: bool = False) -> DataFrame:
    """``df`` with ctx from a callable of (source, line, with_macros); a failing row has no context."""
    import json

    schema = T.StructType([*df.schema.fields, T.StructField("_ctx", T.StringType())])

    def one(source, line) -> str:
        try:
            return json.dumps(extract(source, int(line), with_macros) or {}, ensure_ascii=False)
        except Exception:  # noqa: BLE001  whatever a parser raises concerns its row alone
            return "{}"

    def run(batches):
        for pdf in batches:
            yield pdf.assign(_ctx=[one(s, n) for s, n in zip(pdf["source_code"], pdf["error_line"], strict=True)])

    return df.mapInPandas(run, schema).withColumn("ctx", F.from_json("_ctx", CTX_SCHEMA)).drop("_ctx")


def nearest_cursor(cursors: DataFrame) -> DataFrame:
    """Of the cursors that start on a line (file, line, ordinal, length, kind) the one of least extent, the first of equal ones."""
    return cursors.groupBy("file", "line").agg(F.min_by("kind", F.struct("length", "ordinal")).alias("kind"))


def parent_chain(cursors: DataFrame, depth: int = 6) -> DataFrame:
    """(file, id, chain): kinds of parents, nearest first, up to ``depth`` or the root, from (file, id, parent, kind)."""
    up = cursors.select("file", F.col("id").alias("_p"), F.col("parent").alias("_next"), F.col("kind").alias("_kind"))
    now = cursors.select("file", "id", F.col("parent").alias("_at"), F.array().cast("array<string>").alias("chain"))
    for _ in range(depth):
        met = now.join(up, (now["file"] == up["file"]) & (now["_at"] == up["_p"]), "left")
        now = met.select(now["file"], "id", F.col("_next").alias("_at"), F.when(F.col("_kind").isNotNull(), F.concat("chain", F.array("_kind"))).otherwise(F.col("chain")).alias("chain"))
    return now.select("file", "id", "chain")


def tokens_near(tokens: DataFrame, line: int, radius: int = 2) -> DataFrame:
    """Tokens (line, ordinal, spelling) within ``radius`` lines."""
    return tokens.where(F.col("line").between(line - radius, line + radius))
