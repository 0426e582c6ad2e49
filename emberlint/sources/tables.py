"""Typed readers and writers."""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlint.functions import values as V

_TEXT, _INT, _LONG, _BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
_TEXTS, _COUNTS = T.ArrayType(_TEXT), T.MapType(_TEXT, _LONG)


@lru_cache(maxsize=1)
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="emberlint-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a folder of its own, removed at exit; on a cluster that is refused, as
    executors wouldn't see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder()

@lru_cache(maxsize=1)
def _scratch_paths() -> list:
    """(path, JVM, configuration) of this process's scratch tables, which go when the process ends, whatever file system they are on."""
    made: list = []

    def remove() -> None:
        for path, jvm, conf in made:
            try:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)
            except Exception:  # noqa: BLE001  the JVM may have ended before
                return

    atexit.register(remove)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder for a table that nothing needs once this process has ended; it is removed then."""
    path = f"{shared_folder(spark)}/emberlint/{label}-{uuid.uuid4().hex}"
    _scratch_paths().append((path, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: what is read more than once is worked out once, and a lost executor costs its tasks alone."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


#: Syntactic context of a submission. Counts are maps, as their keys are open.
CTX_SCHEMA = _struct(
    line=_INT,
    core_info=_struct(kind=_TEXT, spelling=_TEXT, displayname=_TEXT, line=_INT, is_decl=_BOOL, is_expr=_BOOL, is_stmt=_BOOL, type=_TEXT, result_type=_TEXT),
    cursor_meta=_struct(
        op_spelling=_TEXT, lhs_type=_TEXT, rhs_type=_TEXT, lhs_kind=_TEXT, rhs_kind=_TEXT, num_args=_INT, arg_types=_TEXTS, result_type=_TEXT, is_type_ref=_BOOL, ref_kind=_TEXT, ref_type=_TEXT
    ),
    parent_chain=_TEXTS,
    local_tokens_norm=_TEXTS,
    includes=_TEXTS,
    macros=T.ArrayType(_struct(kind=_TEXT, name=_TEXT, spelling=_TEXT, line=_INT)),
    aliases_ns=_struct(using_directives=_TEXTS, using_decls=_TEXTS, typedefs=T.ArrayType(_struct(name=_TEXT, underlying=_TEXT, kind=_TEXT)), namespaces=_TEXTS),
    decls=_struct(type_kind_counts=_COUNTS, var_kind_counts=_COUNTS, var_type_counts=_COUNTS, func_kind_counts=_COUNTS),
)
CTX_FILE = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("ctx", CTX_SCHEMA)])
TRAINING_SCHEMA = (
    "label int, error_text string, error_text_tokens string, error_code string, error_line int, source_code string, ctx_tokens string, ctx_numeric string, is_in_train int"
)


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet, only the named columns if any are named."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_contexts(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON lines of (row_id, ctx) from any number of files; absent keys are null, blank lines are skipped."""
    return spark.read.schema(CTX_FILE).json(list(paths))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Each line that isn't blank, parsed on its own; a line that can't be parsed gives nulls."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_json_lines(df: DataFrame, path: str, keep_nulls: bool = False) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def write_lines(df: DataFrame, path: str) -> None:
    """Each row as one JSON object in a line of text."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """To a path that ``df`` doesn't read from."""
    df.write.mode("overwrite").parquet(path)


def stage(df: DataFrame, name: str, schema: str) -> DataFrame:
    """A view with the columns and types of ``schema``, replacing one of that name."""
    fields = T.StructType.fromDDL(schema).fields
    df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields)).createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def unstage(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def describe(df: DataFrame) -> DataFrame:
    """(position, name, type) of a frame's columns."""
    rows = [(k, f.name, f.dataType.simpleString()) for k, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")


def browse(df: DataFrame, limit: int = -1) -> DataFrame:
    return df if limit < 0 else df.limit(limit)


def one_row(spark: SparkSession, schema: str, **values) -> DataFrame:
    fields = T.StructType.fromDDL(schema)
    return spark.createDataFrame([tuple(values.get(f.name) for f in fields)], fields)


def load_config(path: str) -> dict | list:
    import yaml

    return yaml.safe_load(pathlib.Path(path).read_text(encoding="utf-8"))


def error_codes(spark: SparkSession) -> DataFrame:
    """(error_code_id, error_code) of codes that have recommendations, numbered from 1."""
    codes = dict.fromkeys(c for c, _ in V.RECOMMENDATIONS)
    return spark.createDataFrame([(k, c) for k, c in enumerate(codes, 1)], "error_code_id int, error_code string")


def recommendations(spark: SparkSession, texts: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """(recommendation_id, error_code_id, recommendation, recommendation_code, is_active); texts by (code, recommendation code)."""
    codes = {c: k for k, c in enumerate(dict.fromkeys(c for c, _ in V.RECOMMENDATIONS), 1)}
    rows = [(k, codes[c], (texts or {}).get((c, r), f"{c}: {r}"), r, 1) for k, (c, r) in enumerate(V.RECOMMENDATIONS, 1)]
    return spark.createDataFrame(rows, "recommendation_id int, error_code_id int, recommendation string, recommendation_code string, is_active int")


def create_tables(spark: SparkSession, database: str) -> None:
    """Tables of the two dimensions and an empty one for training data, as Parquet; constraints are checked by queries."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    error_codes(spark).write.mode("overwrite").saveAsTable(f"{database}.error_codes")
    recommendations(spark).write.mode("overwrite").saveAsTable(f"{database}.recommendations")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.training_data ({TRAINING_SCHEMA}) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.classification_models (name string, description string, path string, accuracy double, f1score double, rocauc double) USING parquet")


def copy_table(spark: SparkSession, name: str, path: str) -> None:
    """A snapshot of a table."""
    spark.table(name).write.mode("overwrite").parquet(path)


def first_entry(entries: list[dict], key: str, value) -> dict | None:
    """The first entry of a configuration whose ``key`` is ``value``, None without one."""
    return next((e for e in entries if e.get(key) == value), None)


def seed_relation(spark: SparkSession, *selects: str) -> DataFrame:
    """The bag union of literal SELECTs, as seed scripts put dimensions together."""
    if not selects:
        raise ValueError("no SELECT")
    return spark.sql(" UNION ALL ".join(f"({s})" for s in selects))
