"""Registered queries of the relational operators, each with the same result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlint.functions import diagnostics as D
from emberlint.functions import text as X
from emberlint.functions import types as Y
from emberlint.functions import values as V
from emberlint.operators import contexts as C
from emberlint.operators import evaluation as E
from emberlint.operators import labeling as L
from emberlint.operators import matrix as M
from emberlint.operators import rows as R
from emberlint.plans import serving, training
from emberlint.sources import tables as S
from emberlint.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        name = f.__name__
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql.strip()
        return f

    return register


#: Synthetic diagnostics and programs from the events table; the text means the same in both engines.
DIAG = r"""
SELECT event_id AS row_id, error_code, error_line,
 CASE error_code
  WHEN 'C2065' THEN concat('C2065: ', ident, ': необъявленный идентификатор')
  WHEN 'C3861' THEN concat('C3861: ', ident, ': идентификатор не найден')
  WHEN 'C2146' THEN concat('C2146: синтаксическая ошибка: отсутствие ";" перед идентификатором "', ident, '"')
  WHEN 'C2676' THEN concat('C2676: бинарный "', op, '": "', typ, '" не определяет этот оператор')
  WHEN 'C1083' THEN concat('C1083: Не удается открыть файл включение: ', ident, '.h: No such file or directory')
  WHEN 'C2039' THEN concat('C2039: "', ident, '": не является членом "', typ, '"')
  WHEN 'C2143' THEN concat('C2143: синтаксическая ошибка: отсутствие "', op, '" перед "константа"')
  WHEN 'C1075' THEN 'C1075: "{": не найдена соответствующая лексема'
  ELSE concat('C2440: инициализация: невозможно преобразовать "', typ, '" в "int"') END AS error_text
FROM (SELECT event_id, CAST(user_id % 40 + 1 AS INT) AS error_line,
  CASE event_id % 9 WHEN 0 THEN 'C2065' WHEN 1 THEN 'C3861' WHEN 2 THEN 'C2146' WHEN 3 THEN 'C2676' WHEN 4 THEN 'C1083' WHEN 5 THEN 'C2039' WHEN 6 THEN 'C2143' WHEN 7 THEN 'C1075' ELSE 'C2440' END AS error_code,
  CASE user_id % 6 WHEN 0 THEN 'cout' WHEN 1 THEN 'retrun' WHEN 2 THEN 'abc' WHEN 3 THEN 'sqrt' WHEN 4 THEN '?cin' ELSE 'my_var' END AS ident,
  CASE user_id % 3 WHEN 0 THEN '+' WHEN 1 THEN '[' ELSE '==' END AS op,
  CASE event_id % 4 WHEN 0 THEN 'std::pair<int,int>' WHEN 1 THEN 'const char *' WHEN 2 THEN 'std::stack<int>' ELSE 'Foo' END AS typ
 FROM events) e
"""
SNIP = r"""
SELECT event_id AS row_id, CAST(event_id % 9 + 1 AS INT) AS error_line,
 concat('#include <', CASE event_id % 4 WHEN 0 THEN 'iostream' WHEN 1 THEN 'vector' WHEN 2 THEN 'bits/stdc++.h' ELSE 'cmath' END, '>', chr(10),
  CASE WHEN event_id % 7 = 0 THEN concat('#define N 10', chr(10)) ELSE '' END,
  'using namespace std; // ns', chr(10), 'int main() {', chr(10),
  '  ', CASE user_id % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'long long' WHEN 2 THEN 'double' ELSE 'string' END, ' v', CAST(user_id AS STRING), ' = ', CAST(event_id % 100 AS STRING), '; /* blk', chr(10), ' two */', chr(10),
  '  cout << "a // not comment" << v', CAST(user_id AS STRING), ' << endl;', chr(10), '  return 0;', chr(10), '}') AS source_code
FROM events
"""
_D, _S = f"WITH diag AS ({DIAG}) ", f"WITH snip AS ({SNIP}) "
_DS = f"WITH diag AS ({DIAG}), snip AS ({SNIP}) "
_REC = ", ".join(f"({k}, '{c}', '{r}')" for k, (c, r) in enumerate(V.RECOMMENDATIONS, 1))
_DIM = f"rec(recommendation_id, error_code, recommendation_code) AS (VALUES {_REC})"


def events(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return S.read_parquet(spark, f"{sf}/events.parquet", *columns)


def _view(spark: SparkSession, sf: str, text: str) -> DataFrame:
    name = f"events_{abs(hash(sf)):x}"
    events(spark, sf).createOrReplaceTempView(name)
    return spark.sql(text.replace("FROM events", f"FROM {name}"))


def diag(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, DIAG)


def snip(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, SNIP)


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    return diag(spark, sf).join(snip(spark, sf).select("row_id", "source_code"), "row_id")


_quoted_list = lambda xs: ", ".join(f"'{x}'" for x in xs)

# --- sources and sinks --------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type FROM events")
def s1_parquet_scan(spark, sf):
    return S.read_parquet(spark, f"{sf}/events.parquet", "event_id", "user_id", "event_type")


@query("SELECT event_id AS row_id, CAST(user_id AS INTEGER) AS n FROM events")
def s3_json_lines_round_trip(spark, sf):
    from emberlint.operators.rows import with_missing

    path = f"{_scratch(spark)}/lines"
    S.write_json_lines(events(spark, sf, "event_id", "user_id").select(F.col("event_id").alias("row_id"), F.col("user_id").cast("int").alias("n")), path)
    return with_missing(S.read_json_lines(spark, path, "row_id long, n int"), "n", "int")


def _scratch(spark: SparkSession) -> str:
    import uuid

    return f"{S.shared_folder(spark)}/emberlint/{uuid.uuid4().hex}"


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s5_json_parse(spark, sf):
    return events(spark, sf).select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'click'")
def s7_training_scan(spark, sf):
    S.stage(events(spark, sf), "staged_events", "event_id bigint, event_type string, value double")
    return spark.sql("SELECT event_id, event_type, value FROM staged_events WHERE event_type = 'click'")


@query("SELECT * FROM (VALUES (0, 'r_regionkey', 'int'), (1, 'r_name', 'string')) t(position, name, type)")
def s9_describe(spark, sf):
    return S.describe(S.read_parquet(spark, f"{sf}/region.parquet"))


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 25")
def s9_browse(spark, sf):
    return S.browse(events(spark, sf, "event_id", "event_type").orderBy("event_id"), 25)


@query("""SELECT '["a"]' AS error_text_tokens, '{"x":1.0}' AS ctx_numeric""")
def s10_one_row(spark, sf):
    return S.one_row(spark, "error_text_tokens string, ctx_numeric string", error_text_tokens='["a"]', ctx_numeric='{"x":1.0}')


@query("SELECT nation.n_name, region.r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def w1_parquet_round_trip(spark, sf):
    path = f"{_scratch(spark)}/joined"
    n, r = (S.read_parquet(spark, f"{sf}/{t}.parquet") for t in ("nation", "region"))
    S.write_parquet(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_name", "r_name"), path)
    return S.read_parquet(spark, path)


# --- rows ---------------------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type FROM events ORDER BY event_id OFFSET 700 LIMIT 100")
def p1_positional_slice(spark, sf):
    return R.positional_slice(events(spark, sf, "event_id", "event_type"), "event_id", 700, 800)


@query("SELECT event_id AS row_id, CAST(value AS VARCHAR) IS NOT NULL AS has_value, CAST(NULL AS VARCHAR) AS error_text FROM events")
def p5_missing_column(spark, sf):
    return R.with_missing(events(spark, sf).select(F.col("event_id").alias("row_id"), F.col("value").isNotNull().alias("has_value")), "error_text", "string")


@query(_D + ", d(c, r) AS (VALUES " + ", ".join(f"('{c}', '{r}')" for c, r in {c: r for c, r in reversed(V.RECOMMENDATIONS)}.items()) + ") SELECT row_id, d.r AS label_code FROM diag LEFT JOIN d ON error_code = c")
def p8_default_label(spark, sf):
    return diag(spark, sf).select("row_id", R.lookup(F.col("error_code"), {c: r for c, r in reversed(V.RECOMMENDATIONS)}).alias("label_code"))


@query("SELECT event_id AS row_id, CASE WHEN event_id IN (3, 5, 8, 13) THEN 0 ELSE 1 END AS is_in_train FROM events")
def p9_override(spark, sf):
    rows = events(spark, sf).select(F.col("event_id").alias("row_id"), F.lit(1).alias("is_in_train"))
    return R.override(rows, "row_id", [3, 5, 8, 13], "is_in_train", 0)


@query("SELECT event_id AS row_id, CASE WHEN event_id % 3 = 0 THEN concat('new', CAST(event_id AS VARCHAR)) ELSE event_type END AS ctx FROM events")
def p10_update_by_key(spark, sf):
    old = events(spark, sf).select(F.col("event_id").alias("row_id"), F.col("event_type").alias("ctx"))
    new = old.where("row_id % 3 = 0").select("row_id", F.concat(F.lit("new"), "row_id").alias("ctx"))
    return R.updated(old, new, "row_id", "ctx")


@query(f"WITH {_DIM} SELECT l.label, CASE WHEN error_code IS NULL THEN 'no recommendation' ELSE concat(error_code, ': ', recommendation_code) END AS recommendation FROM (SELECT CAST(event_id % 21 AS INTEGER) AS label FROM events) l LEFT JOIN rec ON recommendation_id = l.label")
def p12_point_lookup(spark, sf):
    asked = events(spark, sf).select((F.col("event_id") % 21).cast("int").alias("label"))
    return serving.explained(asked, S.recommendations(spark)).select("label", "recommendation")


@query(_S + r"SELECT row_id, CASE WHEN length(replace(source_code, chr(10), '\n')) > 80 THEN concat(substring(replace(source_code, chr(10), '\n'), 1, 77), '...') ELSE replace(source_code, chr(10), '\n') END AS cell FROM snip")
def p14_format_cell(spark, sf):
    return snip(spark, sf).select("row_id", X.format_cell(F.col("source_code")).alias("cell"))


# --- filters ------------------------------------------------------------------------------------------------------


@query(_D + f"SELECT row_id, error_code FROM diag WHERE regexp_matches(error_text, '{'|'.join(V.ERROR_CODES)}')")
def f1_known_codes(spark, sf):
    return training.kept_submissions(diag(spark, sf).drop("error_code")).select("row_id", "error_code")


@query(_DS + r"SELECT snip.row_id FROM snip JOIN diag ON snip.row_id = diag.row_id WHERE NOT regexp_matches(source_code, '#\s*(?:define|undef|if|ifdef|ifndef|elif|pragma)') AND error_code <> 'C1083'")
def f4_without_macros(spark, sf):
    return submissions(spark, sf).where(~X.has_macros(F.col("source_code")) & (F.col("error_code") != "C1083")).select("row_id")


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS kept, count(*) FILTER (event_type <> 'click') AS dropped FROM events")
def g3_counters(spark, sf):
    return R.counters(events(spark, sf, "event_type"), F.col("event_type") == "click")


@query(_D + r"SELECT row_id, regexp_matches(error_text, '\bC2065\b') AS hit FROM diag")
def f8_has_error_code(spark, sf):
    return diag(spark, sf).select("row_id", D.has_error_code(F.col("error_text"), "C2065").alias("hit"))


# --- joins --------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def j1_one_to_one(spark, sf):
    o = S.read_parquet(spark, f"{sf}/orders.parquet")
    return R.one_to_one(o.select("o_orderkey", "o_totalprice"), o.select("o_orderkey", "o_orderpriority"), "o_orderkey")


@query(_D + f", {_DIM}, l AS (SELECT row_id, error_code, CASE row_id % 3 WHEN 0 THEN 'FIX_NAME_SPELLING' WHEN 1 THEN 'FIX_OPERATOR' ELSE 'INCORRECT_FILE_INCLUDE' END AS label_code FROM diag) SELECT row_id, recommendation_id AS label FROM l JOIN rec ON rec.error_code = l.error_code AND recommendation_code = label_code")
def j3_label_ids(spark, sf):
    label = F.when(F.col("row_id") % 3 == 0, "FIX_NAME_SPELLING").when(F.col("row_id") % 3 == 1, "FIX_OPERATOR").otherwise("INCORRECT_FILE_INCLUDE")
    rows = diag(spark, sf).select("row_id", "error_code", label.alias("label_code"))
    known = rows.join(F.broadcast(S.error_codes(spark)), "error_code")
    r = S.recommendations(spark)
    return known.join(F.broadcast(r), (known.label_code == r.recommendation_code) & (known.error_code_id == r.error_code_id)).select("row_id", F.col("recommendation_id").alias("label"))


@query(f"WITH {_DIM} SELECT error_code, recommendation_id, recommendation_code FROM rec ORDER BY error_code, recommendation_id")
def j4_dimensions(spark, sf):
    c, r = S.error_codes(spark), S.recommendations(spark)
    return c.join(r, "error_code_id").where("is_active = 1").select("error_code", "recommendation_id", "recommendation_code").orderBy("error_code", "recommendation_id")


@query("SELECT n_name, t.x AS code FROM nation CROSS JOIN (VALUES ('A'), ('B'), ('C')) t(x) WHERE n_nationkey = 7")
def j5_literal_relation(spark, sf):
    n = S.read_parquet(spark, f"{sf}/nation.parquet").where("n_nationkey = 7")
    return n.crossJoin(spark.createDataFrame([("A",), ("B",), ("C",)], "code string")).select("n_name", "code")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_7')")
def j6_scalar_subquery(spark, sf):
    c, n = (S.read_parquet(spark, f"{sf}/{t}.parquet") for t in ("customer", "nation"))
    return spark.sql("SELECT c_custkey FROM {c} WHERE c_nationkey = (SELECT n_nationkey FROM {n} WHERE n_name = 'NATION_7')", c=c, n=n)


# --- aggregates ---------------------------------------------------------------------------------------------------


@query(f"WITH {_DIM} SELECT error_code, min(recommendation_id) AS recommendation_id, arg_min(recommendation_code, recommendation_id) AS recommendation_code FROM rec GROUP BY error_code")
def g1_first_per_group(spark, sf):
    joined = S.error_codes(spark).join(S.recommendations(spark), "error_code_id")
    return R.first_per_group(joined, ["error_code"], ["recommendation_id"]).select("error_code", "recommendation_id", "recommendation_code")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 1")
def g9_duplicate_keys(spark, sf):
    return R.duplicate_keys(S.read_parquet(spark, f"{sf}/lineitem.parquet", "l_partkey"), "l_partkey")


@query("SELECT user_id, array_to_string(list_sort(list(concat(event_type, '=', CAST(n AS VARCHAR)))), ';') AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def g4_histogram(spark, sf):
    said = F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return C.histogram(events(spark, sf, "user_id", "event_type"), "user_id", "event_type").select("user_id", F.array_join(F.array_sort(said), ";").alias("counts"))


@query(_D + "SELECT error_code, count(*) AS n FROM diag GROUP BY error_code ORDER BY n DESC, error_code LIMIT 5")
def g15_frequent_codes(spark, sf):
    return diag(spark, sf).groupBy("error_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_code").limit(5)


@query("SELECT event_type, user_id, n, CAST(rank() OVER (PARTITION BY event_type ORDER BY n DESC) AS INTEGER) AS place FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)")
def g16_ranked_by_frequency(spark, sf):
    n = events(spark, sf).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.rank().over(Window.partitionBy("event_type").orderBy(F.desc("n"))))


@query("SELECT event_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id FROM events WHERE event_id % 3 = 0")
def u1_bag_union(spark, sf):
    e = events(spark, sf, "event_id")
    return e.where("event_id % 2 = 0").unionByName(e.where("event_id % 3 = 0"))


# --- windows and sampling -----------------------------------------------------------------------------------------


@query(_S + "SELECT row_id, array_to_string(list_slice(string_split(source_code, chr(10)), greatest(error_line - 1, 1), error_line + 1), '|') AS near FROM snip")
def n1_line_window(spark, sf):
    return snip(spark, sf).select("row_id", F.array_join(X.line_window(F.col("source_code"), F.col("error_line")), "|").alias("near"))


@query(_S + "SELECT row_id, len(string_split(source_code, chr(10))) AS n FROM snip")
def n2_wide_window(spark, sf):
    return snip(spark, sf).select("row_id", F.size(X.wide_window(F.col("source_code"), F.lit(99))).cast("long").alias("n"))


@query(_S + "SELECT row_id, array_to_string([concat(lpad(CAST(i AS VARCHAR), CAST(length(CAST(len(l) AS VARCHAR)) AS INTEGER), ' '), ' | ', l[i]) for i in range(1, len(l) + 1)], chr(10)) AS numbered FROM (SELECT row_id, string_split(source_code, chr(10)) AS l FROM snip)")
def n4_numbered_lines(spark, sf):
    return snip(spark, sf).select("row_id", X.number_lines(F.col("source_code")).alias("numbered"))


_HASH = "md5(concat(CAST(event_id AS VARCHAR), '-42'))"


@query(f"SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY {_HASH}, event_id) <= round(count(*) OVER (PARTITION BY event_type) * 0.15) AS is_test FROM events")
def n8_stratified_split(spark, sf):
    return R.stratified_split(events(spark, sf, "event_id", "event_type"), "event_type", "event_id").select("event_id", "is_test")


@query(f"SELECT event_id, CAST((row_number() OVER (PARTITION BY event_type ORDER BY {_HASH}, event_id) - 1) % 5 AS INTEGER) AS fold FROM events")
def n9_stratified_folds(spark, sf):
    return R.stratified_folds(events(spark, sf, "event_id", "event_type"), "event_type", "event_id").select("event_id", "fold")


@query(f"SELECT event_id, CAST(CAST(concat('0x', substring({_HASH}, 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold FROM events")
def n9_plain_folds(spark, sf):
    return R.plain_folds(events(spark, sf, "event_id"), "event_id")


@query("SELECT event_id, CAST(event_id // 1000 AS BIGINT) AS batch FROM events")
def n7_batches(spark, sf):
    return R.batch_number(events(spark, sf, "event_id"), "event_id", 1000)


# --- texts --------------------------------------------------------------------------------------------------------

_COMMENT = r"""(?s)("(?:\\.|[^"\\])*(?:"|$)|''(?:\\.|[^''\\])*(?:''|$))|//[^\n]*|/\*.*?(?:\*/|$)"""


@query(_S + rf"SELECT row_id, trim(regexp_replace(source_code, '{_COMMENT}', '\1', 'g')) AS code FROM snip")
def t1_strip_comments(spark, sf):
    return snip(spark, sf).select("row_id", X.strip_comments(F.col("source_code")).alias("code"))


@query(_S + r"SELECT row_id, regexp_replace(source_code, '#\s*include\s*<\s*bits/stdc\+\+\.h\s*>', '" + "' || chr(10) || '".join(f"#include <{h}>" for h in X.STANDARD_INCLUDES) + "', 'g') AS code FROM snip")
def t2_standard_includes(spark, sf):
    return snip(spark, sf).select("row_id", X.replace_bits_header(F.col("source_code")).alias("code"))


@query(_S + r"""SELECT row_id, regexp_replace(source_code, '"(?:\\.|[^"\\])*"', '""', 'g') AS code FROM snip""")
def t4_blank_literals(spark, sf):
    return snip(spark, sf).select("row_id", X.blank_literals(F.col("source_code")).alias("code"))


_LIT = D.LITERAL_WORDS
_Q = '"[^"]+"'
NORMALIZED = rf"""CASE error_code
 WHEN 'C2065' THEN regexp_replace(error_text, ': ([^:]+):', ': <IDENT>:')
 WHEN 'C3861' THEN regexp_replace(error_text, ': ([^:]+):', ': <FUNC>:')
 WHEN 'C2039' THEN regexp_replace(regexp_replace(error_text, '{_Q}', '<IDENT>'), '{_Q}', '<DECL>')
 WHEN 'C2143' THEN regexp_replace(regexp_replace(regexp_replace(error_text, '{_LIT}', '<LITER>', 'g'), '{_Q}', '<TOKEN>'), '{_Q}', '<IDENT>')
 WHEN 'C2146' THEN regexp_replace(regexp_replace(error_text, '{_Q}', '<TOKEN>'), '{_Q}', '<IDENT>')
 WHEN 'C1075' THEN regexp_replace(error_text, '"\{{"', '<BRACE>')
 WHEN 'C2440' THEN regexp_replace(regexp_replace(regexp_replace(error_text, ': ([^:]+):', ': <CONTEXT>'), '{_Q}', '<TYPE_1>'), '{_Q}', '<TYPE_2>')
 WHEN 'C2676' THEN regexp_replace(regexp_replace(error_text, '{_Q}', '<OPER>'), '{_Q}', '<TYPE>')
 WHEN 'C1083' THEN regexp_replace(error_text, '^((?:[^:]*:){{2}}).*$', '\1 <PATH>') END"""


@query(_D + f"SELECT row_id, {NORMALIZED} AS said FROM diag")
def t6_normalize_error(spark, sf):
    return diag(spark, sf).select("row_id", D.normalize_error(F.col("error_text")).alias("said"))


@query(_D + rf"SELECT row_id, array_to_string(regexp_extract_all({NORMALIZED}, '{D.TOKEN}'), '|') AS tokens FROM diag")
def t7_error_tokens(spark, sf):
    return diag(spark, sf).select("row_id", F.array_join(D.error_tokens(F.col("error_text")), "|").alias("tokens"))


_TYPES = ("const char *", "std::pair<int,int>", "unsigned long", "struct  Foo", "std::string", "int [3]", "void (int)", "double &&", "ns::Bar", "bool", "wchar_t", "volatile float", "", "MyType")
_TYPES_SQL = f"(SELECT event_id, CASE event_id % {len(_TYPES)} " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_TYPES)) + " END AS t FROM events)"
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(t, '\b(const|volatile|restrict)\b', ' ', 'g'), '^\s*(struct|class|enum|union)\s+', ''), '\s+', ' ', 'g'))"
_INTS = "|".join(V.INT_WORDS)
_CATEGORY = rf"""CASE WHEN t = '' THEN 'T_UNKNOWN' WHEN suffix(s, '&') THEN 'T_REF' WHEN contains(s, '*') THEN 'T_PTR' WHEN contains(s, '[') AND contains(s, ']') THEN 'T_ARRAY'
 WHEN contains(s, '(') AND contains(s, ')') THEN 'T_FUNC' WHEN contains(s, '<') AND contains(s, '>') THEN 'T_TEMPLATE' WHEN starts_with(s, 'std::') THEN 'T_STD' WHEN contains(s, '::') THEN 'T_NAMESPACE'
 WHEN lower(s) = 'void' THEN 'T_VOID' WHEN lower(s) = 'bool' THEN 'T_BOOL' WHEN lower(s) IN ({_quoted_list(V.CHAR_WORDS)}) THEN 'T_CHAR' WHEN regexp_matches(lower(s), '(^| )(float|double)( |$)') THEN 'T_FLOAT'
 WHEN regexp_matches(lower(s), '(^| )({_INTS})( |$)') THEN 'T_INT' ELSE 'T_USER' END"""


def _typed(spark, sf):
    return events(spark, sf).select("event_id", F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("event_id") % len(_TYPES) + 1).cast("int")).alias("t"))


@query(f"SELECT event_id, {_CLEAN} AS cleaned FROM {_TYPES_SQL}")
def t8_clean_type(spark, sf):
    return _typed(spark, sf).select("event_id", Y.clean_type(F.col("t")).alias("cleaned"))


@query(f"SELECT event_id, {_CATEGORY} AS category FROM (SELECT *, {_CLEAN} AS s FROM {_TYPES_SQL})")
def t9_type_category(spark, sf):
    return _typed(spark, sf).select("event_id", Y.type_category(F.col("t")).alias("category"))


_HEADERS = ("iostream", "vector", "bits/stdc++.h", "cmath", "sstream", "sys\\thread.h", "string.h", "unknown.hpp")
_HEADERS_SQL = f"(SELECT event_id, CASE event_id % {len(_HEADERS)} " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_HEADERS)) + " END AS h FROM events)"


@query(
    "SELECT event_id, CASE " + " ".join(f"WHEN b IN ({_quoted_list(h)}) THEN '{k}'" for k, h in V.HEADERS.items())
    + rf" END AS category FROM (SELECT event_id, regexp_replace(regexp_replace(h, '^.*[/\\]', ''), '\..*$', '') AS b FROM {_HEADERS_SQL})"
)
def t10_header_category(spark, sf):
    h = F.element_at(F.array(*map(F.lit, _HEADERS)), (F.col("event_id") % len(_HEADERS) + 1).cast("int"))
    return events(spark, sf).select("event_id", Y.header_category(h).alias("category"))


_OUTPUT = "concat('code.cpp', chr(10), 'code.cpp(', CAST(error_line AS STRING), '): warning C4244: x', chr(10), 'code.cpp(77): error ', error_text, chr(10), 'end')"


@query(_D + rf"SELECT row_id, trim(regexp_extract({_OUTPUT}, 'error ([^\n]*)', 1)) AS error_text, CAST(regexp_extract({_OUTPUT}, '\.cpp\((\d+)\)', 1) AS INTEGER) AS error_line FROM diag")
def t11_first_error(spark, sf):
    rows = diag(spark, sf).select("row_id", F.expr(_OUTPUT).alias("output"))
    said, line = X.first_error(F.col("output"))
    return rows.select("row_id", said.alias("error_text"), line.alias("error_line"))


@query(_D + r"SELECT row_id, nullif(trim(regexp_extract(error_text, '^C\d{4}: ([^:]+):', 1)), '') AS ident FROM diag")
def t13_named_identifier(spark, sf):
    return diag(spark, sf).select("row_id", D.named_identifier(F.col("error_text")).alias("ident"))


@query(_D + """SELECT row_id, nullif(trim(regexp_extract(error_text, '(?i)перед\\s+идентификатором\\s*["“”]([^"“”]+)["“”]', 1)), '') AS ident FROM diag""")
def t14_identifier_after_token(spark, sf):
    return diag(spark, sf).select("row_id", D.identifier_after_token(F.col("error_text")).alias("ident"))


@query(_D + """SELECT row_id, nullif(regexp_extract(error_text, 'C2440:.*?преобразовать\\s*"([^"]+)"\\s*в\\s*"([^"]+)"', 1), '') AS source, nullif(regexp_extract(error_text, 'C2440:.*?преобразовать\\s*"([^"]+)"\\s*в\\s*"([^"]+)"', 2), '') AS target FROM diag""")
def t15_conversion_types(spark, sf):
    a, b = D.conversion_types(F.col("error_text"))
    return diag(spark, sf).select("row_id", a.alias("source"), b.alias("target"))


@query(_D + """SELECT row_id, nullif(regexp_extract(error_text, '^C2676: бинарный "([^"]+)": ', 1), '') AS op, array_to_string([trim(x, '"') for x in regexp_extract_all(error_text, '"[^"]*"')], '|') AS quoted FROM diag""")
def t17_operator_and_quoted(spark, sf):
    op, quoted = D.operator_and_quoted(F.col("error_text"))
    return diag(spark, sf).select("row_id", op.alias("op"), F.array_join(quoted, "|").alias("quoted"))


@query(_S + rf"SELECT row_id, array_to_string(list_sort(list_distinct([x for x in regexp_extract_all(source_code, '\b[A-Za-z_][A-Za-z0-9_]*\b') if x NOT IN ({_quoted_list(V.KEYWORDS)})])), ',') AS found FROM snip")
def t21_identifier_candidates(spark, sf):
    found = X.identifier_candidates(F.col("source_code"), F.col("error_line"))
    return snip(spark, sf).select("row_id", F.array_join(F.array_sort(found), ",").alias("found"))


#: Programs that call names of their own and standard ones, some twice, with and without a space.
_CALLS = """
SELECT event_id AS row_id, CAST(event_id % 3 + 1 AS INT) AS error_line, concat('int main() {', chr(10), '  read', CAST(user_id AS STRING), '(x); sqrt (2); solve (y); read', CAST(user_id AS STRING), '(z);', chr(10),
  '  ', CASE event_id % 4 WHEN 0 THEN 'max' WHEN 1 THEN 'printf' WHEN 2 THEN 'helper' ELSE 'swap' END, '(1);', chr(10), '}') AS source_code FROM events
"""


@query("SELECT event_id AS row_id, concat('main,read', CAST(user_id AS VARCHAR), ',solve', CASE event_id % 4 WHEN 2 THEN ',helper' ELSE '' END) AS found FROM events")
def t22_call_candidates(spark, sf):
    found = X.call_candidates(F.col("source_code"), F.col("error_line"), V.std_functions())
    return _view(spark, sf, _CALLS).select("row_id", F.array_join(found, ",").alias("found"))


@query(f"SELECT event_id, regexp_extract(t, '^\\s*(?:const\\s+)?((?:[A-Za-z_]\\w*::)*[A-Za-z_]\\w*)', 1) AS outer_type FROM {_TYPES_SQL}")
def t25_outer_type(spark, sf):
    return _typed(spark, sf).select("event_id", Y.outer_type(F.col("t")).alias("outer_type"))


@query("SELECT event_id, concat('int ', event_type, ' = ', CAST(user_id AS VARCHAR), ';') AS code FROM events")
def t27_fill_template(spark, sf):
    picks = {"IDENT": F.col("event_type"), "NUM": F.col("user_id").cast("string")}
    return events(spark, sf).select("event_id", X.fill_template(F.lit("int <IDENT> = <NUM>;"), picks).alias("code"))


@query(_S + "SELECT row_id, sha256(source_code) AS hash FROM snip")
def t28_code_hash(spark, sf):
    return snip(spark, sf).select("row_id", X.code_hash(F.col("source_code")).alias("hash"))


_LITERALS = ("12", "-3.5", ".5", "1e5", "0x1F", '"s"', "+", "for", "abc", "#")
_CLASSES = ("<NUM>", "<NUM>", "<NUM>", "<STR>", "<STR>", "<STR>", "OP_+", "KEYWORD", "<ID_IDENT>", "#")


@query("SELECT event_id, CASE event_id % 10 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_CLASSES)) + " END AS class FROM events")
def t31_token_class(spark, sf):
    token = F.element_at(F.array(*map(F.lit, _LITERALS)), (F.col("event_id") % 10 + 1).cast("int"))
    return events(spark, sf).select("event_id", X.token_class(token).alias("class"))


@query()
def t34_similarity(spark, sf):
    from emberlint.functions.similarity import ratio

    names = diag(spark, sf).select(D.named_identifier(F.col("error_text")).alias("a")).where("a is not null").distinct()
    return names.select("a", ratio(F.col("a"), F.lit("return")).alias("ratio"))


# --- labeling -----------------------------------------------------------------------------------------------------

_IDENT = r"trim(regexp_extract(error_text, '^C\d{4}: ([^:]+):', 1))"


@query(_D + rf"SELECT row_id, CASE WHEN error_code = 'C2065' AND ({_IDENT} IN ({_quoted_list(V.HEADER_NAMES)}) OR ltrim({_IDENT}, '?$') IN ({_quoted_list(V.HEADER_NAMES)})) THEN 'HEADER_OR_STD_NAMESPACE' END AS label FROM diag")
def l1_header_name(spark, sf):
    return diag(spark, sf).select("row_id", L.header_name("C2065").alias("label"))


@query(
    _D + """SELECT row_id, CASE WHEN error_code <> 'C2676' THEN NULL WHEN op = '+' AND regexp_matches(typ, '^std::(pair|stack)') AND typ LIKE 'std::stack%' THEN 'FIX_EXPR_FOR_OPERATOR'
 WHEN op = '[' AND typ LIKE 'std::stack%' THEN 'FIX_EXPR_FOR_OPERATOR' WHEN op = '==' AND typ LIKE 'std::stack%' THEN NULL WHEN op = '[' THEN NULL ELSE 'FIX_EXPR_FOR_OPERATOR' END AS label
 FROM (SELECT row_id, error_code, regexp_extract(error_text, 'бинарный "([^"]+)": "([^"]+)"', 1) AS op, regexp_extract(error_text, 'бинарный "([^"]+)": "([^"]+)"', 2) AS typ FROM diag)"""
)
def l8_operator_expression(spark, sf):
    rows = submissions(spark, sf)
    return rows.select("row_id", L.operator_expression().alias("label"))


@query()
def l11_apply_labels(spark, sf):
    return L.apply_labels(submissions(spark, sf)).select("row_id", "label_code")


@query()
def plan_recommend(spark, sf):
    return serving.recommend(submissions(spark, sf), S.error_codes(spark), S.recommendations(spark))


# --- contexts -----------------------------------------------------------------------------------------------------

_CTX = """CASE event_id % 3 WHEN 0 THEN concat('{"line":', CAST(event_id % 9 AS STRING), ',"local_tokens_norm":["a","b"],"core_info":{"kind":"K","is_decl":true,"type":"int"},"includes":["iostream","vector","iostream"],"parent_chain":["X","Y","X"],"decls":{"type_kind_counts":{"STRUCT_DECL":2},"var_type_counts":{"int":3,"double":1,"long":2}}}') WHEN 1 THEN '{}' ELSE NULL END"""
_TOKENS = "F_TOK=a|F_TOK=b|F_CORE__KIND=K|F_CORE__TYPE_CAT=T_INT|F_PARENT__D0=X|F_PARENT__D1=Y|F_PARENT__D2=X|F_PARENT__KIND=X|F_PARENT__KIND=Y|F_INC__CAT=IO|F_INC__CAT=CONTAINER|F_DECL__VARS_TYPE_CAT=T_INT|F_DECL__VARS_TYPE_CAT=T_FLOAT"


def contexts(spark, sf):
    rows = events(spark, sf).select(F.col("event_id").alias("row_id"), F.expr(_CTX).alias("text"))
    return rows.select("row_id", F.from_json("text", S.CTX_SCHEMA).alias("ctx"))


@query(f"SELECT event_id AS row_id, CASE WHEN event_id % 3 = 0 THEN '{_TOKENS}' END AS tokens, CASE WHEN event_id % 3 = 0 THEN 5.0::DOUBLE END AS ints, CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE END AS has_struct FROM events")
def a12_context_features(spark, sf):
    tokens, numbers = C.context_features(F.col("ctx"))
    rows = contexts(spark, sf).select("row_id", tokens.alias("t"), numbers.alias("n"))
    value = lambda k: F.try_element_at("n", F.lit(k))
    return rows.select("row_id", F.array_join("t", "|").alias("tokens"), value("N_DECL__VARS_TYPE__T_INT").alias("ints"), value("N_DECL__HAS_STRUCT").alias("has_struct"))


@query("SELECT event_id AS row_id, event_id % 3 <> 0 AS is_empty FROM events")
def f6_empty_contexts(spark, sf):
    return contexts(spark, sf).select("row_id", C.is_empty(F.col("ctx"), S.CTX_SCHEMA).alias("is_empty"))


@query(_D + rf"""SELECT row_id, CAST(to_json(regexp_extract_all({NORMALIZED}, '{D.TOKEN}')) AS VARCHAR) AS tokens FROM diag""")
def a4_tokens_as_json(spark, sf):
    return diag(spark, sf).select("row_id", F.to_json(D.error_tokens(F.col("error_text"))).alias("tokens"))


# --- matrix and measures ------------------------------------------------------------------------------------------

_WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


def _documents(spark, sf):
    return S.read_parquet(spark, f"{sf}/documents.parquet", "doc_id", "text").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("tokens"))


@query(f"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (SELECT doc_id, unnest(w) AS term FROM w UNION ALL SELECT doc_id, concat(w[i], ' ', w[i + 1]) FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)) SELECT doc_id, count(*) AS n, count(DISTINCT term) AS n_distinct FROM g GROUP BY doc_id")
def m1_ngrams(spark, sf):
    terms = M.term_counts(_documents(spark, sf), "doc_id", M.ngrams(F.col("tokens"), 1, 2))
    return terms.groupBy("doc_id").agg(F.sum("value").cast("long").alias("n"), F.count("*").alias("n_distinct"))


_TFIDF = f"""WITH t AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
 w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*) OVER (PARTITION BY term))::DOUBLE) + 1) AS w FROM c)
 SELECT doc_id, count(*) AS n_terms, round(sum(w / norm), 6) AS weight, round(max(w / norm), 6) AS top FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS norm FROM w) GROUP BY doc_id"""


@query(_TFIDF)
def m4_tfidf(spark, sf):
    docs = _documents(spark, sf)
    weights = M.tfidf(M.term_counts(docs, "doc_id", F.col("tokens")), "doc_id", docs.count())
    return weights.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.sum("value"), 6).alias("weight"), F.round(F.max("value"), 6).alias("top"))


@query("SELECT event_id AS row_id, event_type AS term, round(value / max(abs(value)) OVER (PARTITION BY event_type), 9) AS value FROM events")
def m5_max_abs(spark, sf):
    entries = events(spark, sf).select(F.col("event_id").alias("row_id"), F.col("event_type").alias("term"), "value")
    return M.max_abs_scaled(entries).withColumn("value", F.round("value", 9))


@query("SELECT event_id AS row_id, event_type AS term, round(value / sqrt(sum(value * value) OVER w / n - (sum(value) OVER w / n) ^ 2), 6) AS value FROM (SELECT *, (SELECT count(*) FROM events) AS n FROM events) WINDOW w AS (PARTITION BY event_type)")
def m7_standard_scaling(spark, sf):
    rows = events(spark, sf).select(F.col("event_id").alias("row_id"), F.create_map("event_type", "value").alias("m"))
    entries = M.dictionary_entries(rows, "row_id", F.col("m"))
    return M.standard_scaled(entries, rows.count()).withColumn("value", F.round("value", 6))


_KNN = """WITH v AS (SELECT vec_id, label, embedding, sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])) AS norm FROM embeddings),
 p AS (SELECT q.vec_id AS query, r.vec_id, r.label, round(1 - list_sum([q.embedding[i]::DOUBLE * r.embedding[i]::DOUBLE for i in range(1, len(q.embedding) + 1)]) / (q.norm * r.norm), 9) AS distance FROM v q, v r WHERE q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS place FROM p) WHERE place <= 15),
 z AS (SELECT query, bool_or(distance <= 0) AS exact FROM k GROUP BY query),
 s AS (SELECT k.query, label, round(sum(CASE WHEN exact THEN CASE WHEN distance <= 0 THEN 1 ELSE 0 END ELSE 1 / distance END), 9) AS votes FROM k JOIN z ON z.query = k.query GROUP BY ALL)
 SELECT query, label FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY votes DESC, label) AS place FROM s) WHERE place = 1"""


@query(_KNN)
def m10_nearest_neighbours(spark, sf):
    rows = S.read_parquet(spark, f"{sf}/embeddings.parquet")
    near = M.nearest(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 15)
    return M.voted(near, rows, "vec_id", "label")


def _judged(spark, sf):
    return events(spark, sf).select((F.col("event_id") % 4).cast("int").alias("t"), (F.col("user_id") % 4).cast("int").alias("p"), (F.col("user_id") % 7 / 7.0).alias("score"), (F.col("event_id") % 3 == 0).alias("positive"))


_REPORT = """WITH r AS (SELECT event_id % 4 AS t, user_id % 4 AS p FROM events), k AS (SELECT label, (SELECT count(*) FROM r WHERE t = label AND p = label)::DOUBLE AS h, (SELECT count(*) FROM r WHERE p = label)::DOUBLE AS np, (SELECT count(*) FROM r WHERE t = label) AS support FROM (SELECT DISTINCT t AS label FROM r UNION SELECT DISTINCT p FROM r)),
 m AS (SELECT *, CASE WHEN np = 0 THEN 0 ELSE h / np END AS pr, CASE WHEN support = 0 THEN 0 ELSE h / support END AS re FROM k), f AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM m),
 n AS (SELECT sum(h) / sum(support) AS acc, sum(support) AS s FROM f)
 SELECT CAST(label AS VARCHAR) AS label, round(pr, 9) AS precision, round(re, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM f
 UNION ALL SELECT 'accuracy', round(acc, 9), round(acc, 9), round(acc, 9), CAST(s AS BIGINT) FROM n
 UNION ALL SELECT 'macro avg', round(avg(pr), 9), round(avg(re), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM f
 UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 9), round(sum(re * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM f"""


@query(_REPORT)
def m18_classification_report(spark, sf):
    report = E.classification_report(_judged(spark, sf), "t", "p")
    return report.select("label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), F.col("support").cast("long").alias("support"))


@query("SELECT CAST(event_id % 4 AS INTEGER) AS truth, CAST(user_id % 4 AS INTEGER) AS predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event_id % 4), 9) AS share FROM events GROUP BY event_id % 4, user_id % 4")
def m19_confusion(spark, sf):
    return E.confusion(_judged(spark, sf), "t", "p").withColumn("share", F.round("share", 9))


_ROC = """WITH g AS (SELECT user_id % 7 / 7.0::DOUBLE AS threshold, count(*) FILTER (event_id % 3 = 0) AS p, count(*) FILTER (event_id % 3 <> 0) AS n FROM events GROUP BY 1)"""


@query(_ROC + " SELECT round(threshold, 9) AS threshold, round(sum(n) OVER w / (SELECT sum(n) FROM g), 9) AS fpr, round(sum(p) OVER w / (SELECT sum(p) FROM g), 9) AS tpr FROM g WINDOW w AS (ORDER BY threshold DESC)")
def m20_roc_curve(spark, sf):
    return E.roc_curve(_judged(spark, sf)).select(*(F.round(c, 9).alias(c) for c in ("threshold", "fpr", "tpr")))


@query(_ROC + " SELECT round(sum(p * (coalesce(below, 0) + n / 2.0::DOUBLE)) / (sum(p) * sum(n)), 9) AS auc FROM (SELECT *, sum(n) OVER (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM g)")
def m21_roc_auc(spark, sf):
    return E.roc_auc(_judged(spark, sf)).select(F.round("auc", 9).alias("auc"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def x1_windowed_counts(spark, sf):
    out = streams.windowed_counts(events(spark, sf, "ts", "event_type"), "ts", "event_type")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


