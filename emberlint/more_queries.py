"""Further registered queries: one for each remaining relational operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlint.functions import diagnostics as D
from emberlint.functions import predicates as P
from emberlint.functions import text as X
from emberlint.functions import types as Y
from emberlint.functions import values as V
from emberlint.operators import boundary as B
from emberlint.operators import contexts as C
from emberlint.operators import evaluation as E
from emberlint.operators import labeling as L
from emberlint.operators import matrix as M
from emberlint.operators import models
from emberlint.operators import rows as R
from emberlint.plans import modeling, serving, training
from emberlint.queries import _CTX, _D, _DIM, _S, _TYPES_SQL, _quoted_list, _scratch, _typed, contexts, diag, events, query, snip, submissions
from emberlint.sources import tables as S

_pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))
_case = lambda values: f"CASE event_id % {len(values)} " + " ".join(f"WHEN {k} THEN " + ("NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'") for k, v in enumerate(values)) + " END"


def _truth(sample, column, expected):
    """A predicate over sample texts, and the SQL of what it must give."""
    return f"SELECT event_id, {_case(expected)} AS holds FROM events", lambda spark, sf: events(spark, sf, "event_id").select("event_id", column(_pick(sample)).alias("holds"))


# --- sources and sinks


@query("SELECT event_id AS row_id, ctx FROM (SELECT event_id, CAST(event_id % 9 AS INTEGER) AS ctx FROM events)")
def s2_projected_batches(spark, sf):
    path = f"{_scratch(spark)}/wide"
    S.write_parquet(events(spark, sf).select(F.col("event_id").alias("row_id"), (F.col("event_id") % 9).cast("int").alias("ctx"), "props"), path)
    return S.read_parquet(spark, path, "row_id", "ctx")


@query(f"SELECT event_id AS row_id, CAST(json_extract({_CTX}, '$.line') AS INTEGER) AS line FROM events")
def s4_context_files(spark, sf):
    path = f"{_scratch(spark)}/contexts"
    S.write_json_lines(contexts(spark, sf), path)
    return S.read_contexts(spark, path).select("row_id", F.col("ctx.line").alias("line"))


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def s6_sql_to_frame(spark, sf):
    for t in ("customer", "nation"):
        S.read_parquet(spark, f"{sf}/{t}.parquet").createOrReplaceTempView(f"t_{t}")
    return spark.sql("SELECT n_name, count(*) AS n FROM t_customer JOIN t_nation ON c_nationkey = n_nationkey GROUP BY n_name")


@query("SELECT event_id, CAST(event_id % 5 AS INTEGER) AS k, CAST(user_id AS VARCHAR) AS label_code FROM events")
def w2_staging(spark, sf):
    staged = S.stage(events(spark, sf).select("event_id", (F.col("event_id") % 5).alias("k"), F.col("user_id").alias("label_code")), "staging", "event_id bigint, k int, label_code string")
    return staged.select("*")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def w4_text_lines(spark, sf):
    path = f"{_scratch(spark)}/text"
    S.write_lines(events(spark, sf, "event_id", "event_type").where("event_type = 'click'"), path)
    return S.read_json_lines(spark, path, "event_id bigint, event_type string")


@query("SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def w5_insert_select(spark, sf):
    path = f"{_scratch(spark)}/loaded"
    S.read_parquet(spark, f"{sf}/region.parquet").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")).write.parquet(path)
    S.read_parquet(spark, f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query(f"WITH {_DIM} SELECT recommendation_id, recommendation_code FROM rec")
def w7_seeded_dimensions(spark, sf):
    return S.recommendations(spark).select("recommendation_id", "recommendation_code")


@query("SELECT DISTINCT user_id AS k FROM events WHERE user_id % 2 = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click')")
def w11_insert_unless_there(spark, sf):
    e = events(spark, sf)
    new = e.select(F.when(F.col("user_id") % 2 == 1, F.col("user_id")).alias("k"))
    return R.insertable(new, e.where("event_type = 'click'").select(F.col("user_id").alias("k")).distinct(), ["k"], ["k"])


# --- rows, filters, joins


@query("SELECT event_id AS row_id, CAST(user_id AS VARCHAR) AS label, CAST(value AS INTEGER) AS n FROM events WHERE value IS NOT NULL AND value = floor(value)")
def p3_rename_and_cast(spark, sf):
    e = events(spark, sf).where(F.col("value") == F.floor("value"))
    return e.withColumnRenamed("event_id", "row_id").withColumn("label", F.col("user_id").cast("string")).withColumn("n", F.col("value").cast("int")).select("row_id", "label", "n")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click' ORDER BY event_id OFFSET 10 LIMIT 20")
def p11_slice_of_label(spark, sf):
    return R.positional_slice(events(spark, sf, "event_id", "event_type").where("event_type = 'click'"), "event_id", 10, 30)


@query("SELECT concat('event_id: ', CAST(event_id AS VARCHAR), chr(10), 'event_type: ', event_type) AS shown FROM events WHERE event_id = 17")
def p13_row_preview(spark, sf):
    return events(spark, sf).where("event_id = 17").select(F.concat_ws("\n", F.concat(F.lit("event_id: "), "event_id"), F.concat(F.lit("event_type: "), "event_type")).alias("shown"))


@query(_S + r"SELECT row_id FROM snip WHERE regexp_matches(source_code, '#\s*(?:define|undef|if|ifdef|ifndef|elif|pragma)')")
def f2_with_macros(spark, sf):
    return snip(spark, sf).where(X.has_macros(F.col("source_code"))).select("row_id")


@query(_D + "SELECT row_id FROM diag WHERE error_code = 'C1083'")
def f3_one_code(spark, sf):
    return diag(spark, sf).where("error_code = 'C1083'").select("row_id")


@query(f"SELECT event_id AS row_id FROM events WHERE event_id % 3 = 0")
def f7_kept_contexts(spark, sf):
    good, _ = C.split_empty(contexts(spark, sf))
    return good.select("row_id")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND user_id % 2 = 0")
def f10_language_and_status(spark, sf):
    return events(spark, sf).where((F.col("event_type") == "click") & (F.col("user_id") % 2 == 0)).select("event_id")


@query(_D + f", {_DIM}, codes AS (SELECT error_code, row_number() OVER (ORDER BY min(recommendation_id)) AS id FROM rec GROUP BY error_code) SELECT row_id, CAST(id AS INTEGER) AS error_code_id FROM diag JOIN codes USING (error_code)")
def j2_code_ids(spark, sf):
    return diag(spark, sf).join(F.broadcast(S.error_codes(spark)), "error_code").select("row_id", "error_code_id")


@query()
def j10_fuzzy_candidates(spark, sf):
    from emberlint.functions.similarity import best_match

    rows = submissions(spark, sf).where("error_code = 'C2065'")
    ident = D.named_identifier(F.col("error_text"))
    return rows.select("row_id", best_match(ident, X.identifier_candidates(F.col("source_code"), F.col("error_line"))).alias("best"))


# --- aggregates and arrays


@query("SELECT count(*) AS n FROM events WHERE event_type = 'click'")
def g2_filtered_count(spark, sf):
    return events(spark, sf, "event_type").where("event_type = 'click'").agg(F.count("*").alias("n"))


@query("SELECT event_id AS row_id, CASE WHEN event_id % 3 = 0 THEN 2.0::DOUBLE END AS types, CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE END AS floats FROM events")
def g5_sums_by_category(spark, sf):
    _, numbers = C.context_features(F.col("ctx"))
    rows = contexts(spark, sf).select("row_id", numbers.alias("n"))
    return rows.select("row_id", F.try_element_at("n", F.lit("N_DECL__TYPES_TOTAL")).alias("types"), F.try_element_at("n", F.lit("N_DECL__VARS_TYPE__T_FLOAT")).alias("floats"))


@query("SELECT event_id, array_to_string(list_sort(list_distinct(string_split(concat('b,a,b,', event_type), ','))), ',') AS xs FROM events")
def g7_distinct_in_order(spark, sf):
    xs = F.array_distinct(F.split(F.concat(F.lit("b,a,b,"), "event_type"), ","))
    return events(spark, sf).select("event_id", F.array_join(F.array_sort(xs), ",").alias("xs"))


@query("SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def g8_distinct_sets(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.size(F.collect_set("event_type")).cast("long").alias("n"))


@query("SELECT CAST(user_id % 50 AS VARCHAR) AS file, CAST(event_id % 20 AS INTEGER) AS line, arg_min(event_type, (event_id % 7) * 1000000 + event_id) AS kind FROM events GROUP BY ALL")
def g10_smallest_on_line(spark, sf):
    e = events(spark, sf).select((F.col("user_id") % 50).cast("string").alias("file"), (F.col("event_id") % 20).cast("int").alias("line"), F.col("event_id").alias("ordinal"), (F.col("event_id") % 7).alias("length"), F.col("event_type").alias("kind"))
    return B.nearest_cursor(e)


@query(_D + "SELECT row_id, CASE WHEN error_code = 'C2676' THEN regexp_extract(error_text, '\": \"([^\"]+)\"', 1) ELSE NULL END AS kind FROM diag WHERE error_code = 'C2676'")
def g12_longest_type(spark, sf):
    op, quoted = D.operator_and_quoted(F.col("error_text"))
    return diag(spark, sf).where("error_code = 'C2676'").select("row_id", L.best_type(quoted, op).alias("kind"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(greatest(event_id % 10, user_id % 10) AS INTEGER) END AS top FROM events")
def g13_largest_of_list(spark, sf):
    xs = F.when(F.col("event_id") % 3 != 0, F.array((F.col("event_id") % 10).cast("int"), F.lit(None).cast("int"), (F.col("user_id") % 10).cast("int"))).otherwise(F.array().cast("array<int>"))
    return events(spark, sf).select("event_id", F.array_max(xs).alias("top"))


@query("SELECT DISTINCT event_type FROM events ORDER BY 1")
def g14_classes(spark, sf):
    return events(spark, sf, "event_type").distinct().orderBy("event_type")


@query("SELECT event_id, array_to_string([x for x in range(1, least(n, 4) + 1)], ',') AS first_four, n > 4 AS more FROM (SELECT event_id, event_id % 7 AS n FROM events)")
def o3_first_four(spark, sf):
    xs = F.filter(F.sequence(F.lit(0), (F.col("event_id") % 7).cast("int")), lambda x: x > 0)
    return events(spark, sf).select("event_id", F.array_join(F.slice(xs, 1, 4), ",").alias("first_four"), (F.size(xs) > 4).alias("more"))


@query("SELECT event_id AS row_id, CAST(event_id % 9 AS INTEGER) AS line FROM events")
def u3_merged_files(spark, sf):
    e = events(spark, sf).select(F.col("event_id").alias("row_id"), F.struct((F.col("event_id") % 9).cast("int").alias("line")).alias("ctx"))
    return R.merge_contexts(e.where("row_id % 2 = 0"), e.where("row_id % 2 = 1")).select("row_id", F.col("ctx.line").alias("line"))


@query(f"SELECT event_id, CAST({len(set(V.ORDERINGS) | set(V.ITERATOR_ARITHMETIC))} AS INTEGER) AS n_union, CAST({len(set(V.OPERATORS) - set(V.ARITHMETIC))} AS INTEGER) AS n_rest FROM events")
def u4_operator_sets(spark, sf):
    a = lambda xs: F.array(*map(F.lit, xs))
    return events(spark, sf).select("event_id", F.size(F.array_union(a(V.ORDERINGS), a(V.ITERATOR_ARITHMETIC))).alias("n_union"), F.size(F.array_except(a(V.OPERATORS), a(V.ARITHMETIC))).alias("n_rest"))


# --- windows and samples


@query("SELECT event_id, CAST(event_id % 100 AS INTEGER) AS line FROM events WHERE event_id % 100 BETWEEN 8 AND 12")
def n3_tokens_near(spark, sf):
    return B.tokens_near(events(spark, sf).select("event_id", (F.col("event_id") % 100).cast("int").alias("line")), 10)


@query(_S + "SELECT row_id, coalesce(list_filter(l, lambda x: regexp_matches(x, '\\bv[0-9]+\\b'))[1], l[len(l) // 2 + 1]) AS line FROM (SELECT row_id, list_slice(string_split(source_code, chr(10)), greatest(error_line - 1, 1), error_line + 1) AS l FROM snip)")
def n5_focus_line(spark, sf):
    window = X.line_window(F.col("source_code"), F.col("error_line"))
    name = F.regexp_extract("source_code", r"\b(v[0-9]+)\b", 1)
    return snip(spark, sf).select("row_id", X.focus_line(window, name).alias("line"))


@query(_S + "SELECT row_id, array_to_string([x for x in string_split(source_code, chr(10)) if contains(x, ' << ')], '|') AS found FROM snip")
def n6_lines_with_operator(spark, sf):
    return snip(spark, sf).select("row_id", F.array_join(X.focus_lines(X.lines(F.col("source_code")), F.lit("<<")), "|").alias("found"))


@query()
def n10_chosen_values(spark, sf):
    return R.generated_samples(events(spark, sf).select(F.col("event_id").alias("id")), "int <IDENT> = <NUM>;", {"IDENT": ["a", "b", "c"], "NUM": ["1", "2", "10"]})


# --- texts


@query(r"SELECT event_id, concat('a', chr(10), event_type) AS code FROM events")
def t3_unescaped(spark, sf):
    return events(spark, sf).select("event_id", X.unescape_source(F.concat(F.lit("a\\n"), "event_type")).alias("code"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE concat('a', chr(65533)) END AS said FROM events")
def t5_valid_utf8(spark, sf):
    raw = F.when(F.col("event_id") % 2 == 0, F.encode("event_type", "UTF-8")).otherwise(F.unhex(F.lit("61FF")))
    return events(spark, sf).select("event_id", X.valid_utf8(raw).alias("said"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ошибка' ELSE 'error' END AS said FROM events")
def t12_decoded_output(spark, sf):
    raw = F.when(F.col("event_id") % 2 == 0, F.unhex(F.lit("ошибка".encode("cp866").hex()))).otherwise(F.encode(F.lit("error"), "UTF-8"))
    return events(spark, sf).select("event_id", X.decode_output(raw).alias("said"))


_C2446 = ("C2446: ==: нет", "C2446: <: x", " C2446: :: x", "C2446: no", "C2440: ==: x")


@query(f"SELECT event_id, {_case(('==', '<', ':', None, None))} AS op FROM events")
def t16_comparison_operator(spark, sf):
    return events(spark, sf).select("event_id", D.comparison_operator(_pick(_C2446)).alias("op"))


_OPERANDS = ('C2678: бинарный "=": нет операнда типа "const Foo"', "C2678: x", 'C2679: бинарный ">>": не найден операнд типа "int [3]"')


@query(f"SELECT event_id, {_case(('=', None, None))} AS op, {_case(('const Foo', None, None))} AS kind FROM events")
def t18_left_operand(spark, sf):
    op, kind = D.left_operand(_pick(_OPERANDS))
    return events(spark, sf).select("event_id", op.alias("op"), kind.alias("kind"))


@query(f"SELECT event_id, {_case((None, None, '>>'))} AS op, {_case((None, None, 'int [3]'))} AS kind FROM events")
def t19_right_operand(spark, sf):
    op, kind = D.right_operand(_pick(_OPERANDS))
    return events(spark, sf).select("event_id", op.alias("op"), kind.alias("kind"))


@query(_D + """SELECT row_id, array_to_string([trim(trim(x, '"')) for x in regexp_extract_all(error_text, '"[^"]*"')], '|') AS parts FROM diag""")
def t20_quoted_parts(spark, sf):
    return diag(spark, sf).select("row_id", F.array_join(D.quoted_parts(F.col("error_text")), "|").alias("parts"))


@query(rf"SELECT event_id, trim(regexp_replace(regexp_replace(trim(t), '^(class|struct|enum)\s+', ''), '\s+', ' ', 'g')) AS t FROM {_TYPES_SQL}")
def t23_normalized_type(spark, sf):
    return _typed(spark, sf).select("event_id", Y.normalize_type(F.col("t")).alias("t"))


_TARGETS = ("int", "char *", "unsigned int", "ll")


@query(f"SELECT event_id, {_case(('(?:int)', '(?:char)' + chr(92) + 's*' + chr(92) + '*' + chr(92) + 's*', '(?:unsigned' + chr(92) + 's+int)', '(?:ll|long' + chr(92) + 's+long|long' + chr(92) + 's+long' + chr(92) + 's+int|signed' + chr(92) + 's+long' + chr(92) + 's+long|signed' + chr(92) + 's+long' + chr(92) + 's+long' + chr(92) + 's+int)'))} AS pattern FROM events")
def t24_cast_pattern(spark, sf):
    return events(spark, sf).select("event_id", Y.cast_pattern(_pick(_TARGETS)).alias("pattern"))


@query(f"SELECT event_id, {_case(('Foo', 'std::pair', ''))} AS outer_type, {_case(('const,volatile', 'const', ''))} AS qualifiers FROM events")
def t26_outer_and_qualifiers(spark, sf):
    outer, qualifiers = Y.outer_and_qualifiers(_pick(("const volatile struct Foo", "const std::pair<int,int>", "[3]")))
    return events(spark, sf).select("event_id", outer.alias("outer_type"), F.array_join(qualifiers, ",").alias("qualifiers"))


@query(_S + "SELECT row_id, concat('v', regexp_extract(source_code, '<< v([0-9]+)', 1), ',endl') AS names FROM snip")
def t29_shift_operands(spark, sf):
    return snip(spark, sf).select("row_id", F.array_join(X.shift_operands(X.strip_comments(F.col("source_code")), "<<"), ",").alias("names"))


@query(_S + "SELECT row_id, regexp_extract(source_code, '(v[0-9]+) = ', 1) AS name FROM snip")
def t30_assigned_name(spark, sf):
    return snip(spark, sf).select("row_id", X.assigned_name(F.col("source_code")).alias("name"))


@query(_D + r"SELECT row_id, ltrim(trim(regexp_extract(error_text, '^C\d{4}: ([^:]+):', 1)), '?$') AS bare, regexp_matches(trim(regexp_extract(error_text, '^C\d{4}: ([^:]+):', 1)), '[^A-Za-z0-9_]') AS odd FROM diag WHERE error_code = 'C2065'")
def t32_bare_identifier(spark, sf):
    ident = D.named_identifier(F.col("error_text"))
    return diag(spark, sf).where("error_code = 'C2065'").select("row_id", F.regexp_replace(ident, r"^[?$]+", "").alias("bare"), ident.rlike("[^A-Za-z0-9_]").alias("odd"))


# --- predicates: samples with both outcomes

_PREDICATES = {
    "b1_type_like": (("Foo x;", "Foo return;", "v<Foo> x;", "x = Foo;"), lambda x: P.type_like(x, F.lit("Foo")), (True, False, True, False)),
    "b2_control_like": (("; brk;", "x brk", "{ brk;"), lambda x: P.control_like(x, F.lit("brk")), (True, False, True)),
    "b3_loop_like": (("whle (x)", "x whle", "whle x"), lambda x: P.loop_like(x, F.lit("whle")), (True, False, False)),
    "b4_keyword_typo": (("fro", "fors", "whiles"), lambda x: P.keyword_typo(x, F.lit("for"), F.lit(0.7)), (True, False, False)),
    "b5_range_for": (("auto& x : v", "int i = 0; i < 3; i++", "x ? a : b"), P.range_for, (True, False, False)),
    "b6_for_header": (("for (int i = 0, i < 3; i++)", "for (auto& x : v)", "for (;;)", "x"), P.for_without_semicolons, (True, False, False, False)),
    "b7_missing_shift": (("cin a >> b;", "cout << a b;", 'cout << "x" c;', "cout << a;"), P.missing_shift, (True, True, True, False)),
    "b8_call_arguments": (("f(a b);", 'printf("%d" b);', "f(a, b);", "if (a b)"), lambda x: P.missing_separator_in_call(x, F.lit("b")), (True, True, False, False)),
    "b9_condition": (("if (a b)", "while (int b)", "if (a && b)"), lambda x: P.missing_operator_in_condition(x, F.lit("b")), (True, False, False)),
    "b10_declares": (("std::x", "int", "Foo", "ll"), P.declares, (True, True, False, True)),
    "b11_declaration": (("int a b;", "int a = 1 b;", "return a b;", "a b;"), lambda x: P.missing_comma_in_declaration(x, F.lit("b")), (True, True, False, False)),
    "b12_cast": (("(int) x", "static_cast<int>(x)", "sizeof(int)", "int(x)"), lambda x: P.has_cast(x, F.lit("(?:int)")), (True, True, False, True)),
    "b13_string_literal": (('"a"', "a", 'u8"b"'), P.has_string, (True, False, True)),
    "b14_null_comparison": (("p == nullptr", 'p == "NULL"', "0 == p", "p == q"), lambda x: P.compared_with_null(x, F.lit("==")), (True, False, True, False)),
    "b15_arithmetic_type": (("unsigned", "Foo", "size_t"), P.arithmetic_type, (True, False, True)),
    "b16_string_comparison": (('a == "x"', "a == x", '"x" == a'), lambda x: P.string_compared(x, F.lit("==")), (True, False, True)),
    "b17_type_spelling": (("==", "char *", "Foo", "a::b", "ll"), P.type_spelling, (False, True, False, True, True)),
    "b18_char_array": (("const char [3]", "int [3]", "char"), P.char_array, (True, False, False)),
    "b19_shift_before": (("cout << a == b", "a == b", "x << a == b"), lambda x: P.shift_before(x, F.lit("=="), P.COUT_SHIFT, P.INSERTED), (True, False, True)),
    "b20_kinds": (("std::vector<int>", "std::string", "Foo", "std::map"), lambda x: P.is_kind(x, "container"), (True, False, False, True)),
}
for _name, (_sample, _column, _expected) in _PREDICATES.items():
    _sql, _run = _truth(_sample, _column, _expected)
    _run.__name__ = _name
    query(_sql)(_run)

# --- labels one by one


@query(_D + f"SELECT row_id, CASE WHEN error_code = 'C3861' AND (i IN ({_quoted_list(V.HEADER_NAMES)}) OR ltrim(i, '?$') IN ({_quoted_list(V.HEADER_NAMES)})) THEN 'HEADER_OR_STD_NAMESPACE' END AS label FROM (SELECT *, trim(regexp_extract(error_text, '^C\\d{{4}}: ([^:]+):', 1)) AS i FROM diag)")
def l3_header_function(spark, sf):
    return diag(spark, sf).select("row_id", L.header_name("C3861").alias("label"))


def _label_query(name, function, code, text, sources, expected):
    def run(spark, sf):
        rows = events(spark, sf, "event_id").select("event_id", F.lit(code).alias("error_code"), F.lit(text).alias("error_text"), _pick(sources).alias("source_code"), F.lit(1).alias("error_line"))
        return rows.select("event_id", function().alias("label"))

    run.__name__ = name
    query(f"SELECT event_id, {_case(expected)} AS label FROM events")(run)


_label_query("l2_variable_spelling", L.variable_spelling, "C2065", "C2065: conut: x", ("int count1; conut = 1;", "int zzz;"), ("FIX_NAME_SPELLING", None))
_label_query("l4_function_spelling", L.function_spelling, "C3861", "C3861: myfnu: x", ("myfun(1); myfnu(2);", "zzz(1);"), ("FIX_NAME_SPELLING", None))
_label_query("l5_construction", L.wrong_construction, "C2146", 'C2146: x перед идентификатором "b"', ("f(a b);", "x = 1", "int a b;"), ("INCORRECT_CONSTRUCTION_OR_SYMBOLS", None, "INCORRECT_CONSTRUCTION_OR_SYMBOLS"))
_label_query("l6_failing_cast", L.failing_cast, "C2440", 'C2440: x: невозможно преобразовать "a" в "int"', ("y = (int) x;", "y = x;"), ("FIX_CAST", None))
_label_query("l7_pointer_comparison", L.pointer_comparison, "C2446", 'C2446: ==: нет "int" в "char *"', ("if (s == 3)", "if (s == NULL)", "if (s)"), ("FIX_POINTERS_FOR_CAST", None, None))
_label_query("l9_left_operand", L.left_operand, "C2678", 'C2678: бинарный "&&": нет операнда типа "std::string"', ("if (s && t)", "if (s.empty() && t)"), ("FIX_LEFT_OPERAND", None))
_label_query("l10_right_operand", L.right_operand, "C2679", 'C2679: бинарный "[": нет операнда типа "char"', ("a['xy']", "a['x']"), ("FIX_RIGHT_OPERAND", None))

# --- contexts


@query("SELECT event_id AS row_id, CASE WHEN event_id % 2 = 0 THEN '{\"line\":1,\"includes\":[\"a\"]}' ELSE NULL END AS ctx FROM events")
def a1_pruned(spark, sf):
    text = F.when(F.col("event_id") % 2 == 0, F.lit('{"line":1,"includes":["a",null],"macros":[],"core_info":{"kind":null},"decls":{"type_kind_counts":{}}}')).otherwise("{}")
    rows = events(spark, sf).select(F.col("event_id").alias("row_id"), F.from_json(text, S.CTX_SCHEMA).alias("ctx"))
    return C.cleaned(rows).select("row_id", F.to_json("ctx").alias("ctx"))


@query(f"SELECT event_id AS row_id, CASE WHEN event_id % 3 = 0 THEN 13 END AS n_tokens, event_id % 3 <> 0 AS none FROM events")
def a3_context_columns(spark, sf):
    tokens, numbers = C.context_columns(F.col("ctx"))
    rows = contexts(spark, sf).select("row_id", tokens.alias("t"), numbers.alias("n"))
    return rows.select("row_id", F.when(F.col("t").isNotNull(), F.size(C.tokens_of(F.col("t")))).alias("n_tokens"), (F.col("t").isNull() & F.col("n").isNull()).alias("none"))


@query("SELECT event_id, 'F_TOK=a|F_TOK=b' AS tokens, 'F_PARENT__D0=a|F_PARENT__D1=b' AS numbered FROM events")
def a6_prefixed_tokens(spark, sf):
    xs = F.array(F.lit("a"), F.lit("b"))
    return events(spark, sf).select("event_id", F.array_join(F.transform(xs, lambda v: F.concat(F.lit("F_TOK="), v)), "|").alias("tokens"), F.array_join(F.transform(xs, lambda v, i: F.concat(F.lit("F_PARENT__D"), i.cast("string"), F.lit("="), v)), "|").alias("numbered"))


# --- boundaries


@query("SELECT event_id AS row_id, CASE WHEN event_id % 2 = 0 THEN concat('C2065: v', CAST(user_id AS VARCHAR), ': x') ELSE 'ok' END AS error_text, CASE WHEN event_id % 2 = 0 THEN 3 END AS error_line FROM events")
def e1_compiled(spark, sf):
    code = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("bad v"), "user_id")).otherwise("good")
    rows = events(spark, sf).select(F.col("event_id").alias("row_id"), code.alias("source_code"))
    fake = lambda s: f"code.cpp(3): error C2065: {s.split()[1]}: x".encode() if s.startswith("bad") else b"ok"
    return B.compiled(rows, fake).select("row_id", "error_text", "error_line")


@query("SELECT event_id AS row_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 9 + 1 AS INTEGER) END AS line FROM events")
def e12_extracted_contexts(spark, sf):
    rows = events(spark, sf).select(F.col("event_id").alias("row_id"), F.when(F.col("event_id") % 2 == 0, "good").otherwise("bad").alias("source_code"), (F.col("event_id") % 9 + 1).cast("int").alias("error_line"))

    def extract(source, line, with_macros):
        if source == "bad":
            raise RuntimeError("a parser's failure")
        return {"line": line}

    return B.with_contexts(rows, extract).select("row_id", F.col("ctx.line").alias("line"))


@query("WITH RECURSIVE t AS (SELECT DISTINCT event_id // 2 AS parent, event_id AS id FROM events), c(id, up, n) AS (SELECT id, parent, 0 FROM t UNION ALL SELECT c.id, t.parent, n + 1 FROM c JOIN t ON t.id = c.up WHERE n < 6) SELECT id, CAST(max(n) AS INTEGER) AS depth FROM c GROUP BY id")
def e7_parent_chain(spark, sf):
    tree = events(spark, sf).select(F.lit("f").alias("file"), F.col("event_id").alias("id"), F.floor(F.col("event_id") / 2).cast("long").alias("parent"), F.lit("K").alias("kind"))
    return B.parent_chain(tree).select("id", F.size("chain").alias("depth"))


# --- matrices, models, measures


@query("SELECT doc_id, count(*) AS n_terms, CAST(sum(n) AS BIGINT) AS n FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY ALL) GROUP BY doc_id")
def m2_term_counts(spark, sf):
    docs = S.read_parquet(spark, f"{sf}/documents.parquet", "doc_id", "text")
    terms = M.term_counts(docs, "doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return terms.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("value").cast("long").alias("n"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z]+')) AS BIGINT) AS n FROM documents WHERE len(regexp_extract_all(lower(text), '[a-z]+')) > 0")
def m3_hashed_counts(spark, sf):
    docs = S.read_parquet(spark, f"{sf}/documents.parquet", "doc_id", "text")
    terms = M.hashed_counts(docs, "doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return terms.groupBy("doc_id").agg(F.sum("value").cast("long").alias("n"))


@query("SELECT event_id AS row_id, event_type AS term, value FROM events WHERE value IS NOT NULL")
def m6_dictionary(spark, sf):
    rows = events(spark, sf).where("value is not null").select(F.col("event_id").alias("row_id"), F.create_map("event_type", "value").alias("m"))
    return M.dictionary_entries(rows, "row_id", F.col("m"))


@query("SELECT event_id AS row_id, concat('a:', event_type) AS term, 1.0::DOUBLE AS value FROM events UNION ALL SELECT event_id, concat('b:', event_type), 2.0::DOUBLE FROM events")
def m8_assembled(spark, sf):
    part = lambda v: events(spark, sf).select(F.col("event_id").alias("row_id"), F.col("event_type").alias("term"), F.lit(v).alias("value"))
    return M.assembled(a=part(1.0), b=part(2.0))


def _classified(spark, sf):
    from pyspark.ml.functions import array_to_vector

    rows = S.read_parquet(spark, f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return R.stratified_folds(models.balanced(rows, "label"), "label", "row_id", k=2)


@query("SELECT vec_id AS row_id, round((SELECT count(*) FROM embeddings) / ((SELECT count(DISTINCT label) FROM embeddings) * count(*) OVER (PARTITION BY label))::DOUBLE, 9) AS weight FROM embeddings")
def m11_balanced_weights(spark, sf):
    rows = S.read_parquet(spark, f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), "label")
    return models.balanced(rows, "label").select("row_id", F.round("weight", 9).alias("weight"))


@query("SELECT event_id, CASE WHEN 2 * (user_id % 5) + event_id % 5 + (event_id % 4) > 7 THEN 'high' ELSE 'low' END AS prediction FROM events")
def m9_averaged_descent(spark, sf):
    """Each digit is a feature of its own, so the weights that tell high from low have to be learned together."""
    from emberlint.operators import descent

    rows = events(spark, sf).select("event_id", "user_id")
    digits = (F.col("user_id") % 5, 5 + F.col("event_id") % 5, 10 + F.col("event_id") % 4)
    rows = rows.withColumn("features", F.array(*(F.struct(d.cast("int").alias("index"), F.lit(1.0).alias("value")) for d in digits)))
    rows = rows.withColumn("label", F.when(2 * (F.col("user_id") % 5) + F.col("event_id") % 5 + F.col("event_id") % 4 > 7, "high").otherwise("low"))
    model = descent.fit(rows, 14, descent.Descent(alpha=1e-5, epochs=12, partitions=4), key="event_id")
    return descent.predicted(rows.select("event_id", "features"), model).select("event_id", "prediction")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'inner' ELSE 'outer' END AS prediction FROM events")
def m12_kernel_machine(spark, sf):
    """Two rings, which no line tells apart: places by a radial kernel, then a linear machine."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    from emberlint.operators import kernels

    turn, far = F.radians(F.col("user_id") % 360), F.when(F.col("event_id") % 3 == 0, 1.0).otherwise(2.0)
    rows = events(spark, sf).select("event_id", F.array(far * F.cos(turn), far * F.sin(turn)).alias("features"), (F.col("event_id") % 3 == 0).cast("double").alias("label"))
    places = kernels.mapped(rows, kernels.fit(rows, kernels.Kernel("rbf", 1.0), 60, key="event_id")).withColumn("features", array_to_vector("features"))
    found = LinearSVC(maxIter=30, regParam=0.001).fit(places).transform(places)
    return found.select("event_id", F.when(F.col("prediction") == 1, "inner").otherwise("outer").alias("prediction"))


@query("SELECT 's' || CAST(user_id % 37 AS VARCHAR) AS program, min(event_id) AS event_id FROM events GROUP BY 1")
def x2_first_programs(spark, sf):
    from emberlint.streaming.streams import first_programs

    rows = events(spark, sf).select("event_id", F.concat(F.lit("s"), F.col("user_id") % 37).alias("program"))
    return first_programs(rows, "event_id", code="program").select("program", "event_id")


@query()
def m17_out_of_fold(spark, sf):
    return models.out_of_fold(_classified(spark, sf), "logistic", {"maxIter": 10, "regParam": 0.1}, k=2).select("row_id", "label", "prediction")


@query(
    "WITH s AS (SELECT k, event_id % 4 = k AS hit, CAST((event_id * (k + 3) + user_id) % 11 AS DOUBLE) / 10 AS score FROM events JOIN (VALUES (0), (1), (2), (3)) v(k) ON true),"
    " r AS (SELECT k, hit, rank() OVER (PARTITION BY k ORDER BY score) + (count(*) OVER (PARTITION BY k, score) - 1) / 2.0 AS place FROM s)"
    " SELECT CAST(k AS VARCHAR) AS label, round((sum(CASE WHEN hit THEN place END) - count_if(hit) * (count_if(hit) + 1) / 2.0) / (count_if(hit) * count_if(NOT hit))::DOUBLE, 9) AS auc FROM r GROUP BY k"
)
def m22_auc_by_class(spark, sf):
    score = lambda k: ((F.col("event_id") * (k + 3) + F.col("user_id")) % 11).cast("double") / 10
    rows = events(spark, sf).select("event_id", (F.col("event_id") % 4).alias("t"), F.create_map(*(x for k in range(4) for x in (F.lit(str(k)), score(k)))).alias("scores"))
    return E.roc_auc(E.one_vs_rest(rows, "event_id", "t", "scores"), "label").select("label", F.round("auc", 9).alias("auc"))


@query(f"WITH {_DIM} SELECT event_id AS row_id, concat(error_code, ': ', recommendation_code) AS recommendation FROM events JOIN rec ON recommendation_id = event_id % 19 + 1")
def m25_explained_predictions(spark, sf):
    predicted = events(spark, sf).select(F.col("event_id").alias("row_id"), (F.col("event_id") % 19 + 1).cast("int").alias("label"))
    return serving.explained(predicted, S.recommendations(spark)).select("row_id", "recommendation")


_LABEL = "CAST(event_id % 3 + 1 AS INTEGER)"


@query(f"WITH {_DIM} SELECT event_id AS row_id, {_LABEL} AS label, concat(error_code, ': ', recommendation_code) AS recommendation FROM events JOIN rec ON recommendation_id = {_LABEL}")
def plan_model_round_trip(spark, sf):
    """Classes that their tokens tell apart: a classifier is trained, saved, loaded again and asked for all rows."""
    label = (F.col("event_id") % 3 + 1).cast("int")
    rows = events(spark, sf).select(
        F.col("event_id").alias("row_id"),
        label.alias("label"),
        F.to_json(F.array(F.lit("C2065"), F.concat(F.lit("kind"), label.cast("string")), "event_type")).alias("error_text_tokens"),
        F.to_json(F.array(F.concat(F.lit("ctx"), label.cast("string")))).alias("ctx_tokens"),
        F.to_json(F.create_map(F.lit("N"), label.cast("double"))).alias("ctx_numeric"),
    )
    path = _scratch(spark)
    modeling.train_and_evaluate(rows, path, params={"maxIter": [20], "regParam": [0.01]}, folds=2)
    return modeling.predicted(rows, path, S.recommendations(spark)).select("row_id", "label", "recommendation")


_LINES = ("#include <map>", "  # define N 1", "#ifndef X", "#elif Y", "#else", "#endif", "#pragma once", "#error no", "int x;")


@query(f"SELECT event_id, {_case(('<PP_INCLUDE>', '<PP_DEFINE>', '<PP_IF>', '<PP_ELIF>', '<PP_ELSE>', '<PP_ENDIF>', '<PP_PRAGMA>', '<PP_OTHER>', None))} AS class FROM events")
def e8_directive_class(spark, sf):
    return events(spark, sf).select("event_id", X.directive_class(_pick(_LINES)).alias("class"))


#: A diagnostic of each code and what must become of it, written by hand; @ stands for a name, # for a type, both of which vary by row.
_SAID = (
    ("C2065: @: необъявленный идентификатор", "C2065: <IDENT>: необъявленный идентификатор"),
    ("C3861: @: идентификатор не найден", "C3861: <FUNC>: идентификатор не найден"),
    ("C2672: @: соответствующая перегруженная функция не найдена", "C2672: <FUNC>: соответствующая перегруженная функция не найдена"),
    ('C2039: "@": не является членом "#"', "C2039: <IDENT>: не является членом <DECL>"),
    ('C2143: синтаксическая ошибка: отсутствие ")" перед "@"', "C2143: синтаксическая ошибка: отсутствие <TOKEN> перед <IDENT>"),
    ('C2143: синтаксическая ошибка: отсутствие ";" перед "константа"', "C2143: синтаксическая ошибка: отсутствие <TOKEN> перед <LITER>"),
    ('C2146: синтаксическая ошибка: отсутствие ";" перед идентификатором "@"', "C2146: синтаксическая ошибка: отсутствие <TOKEN> перед идентификатором <IDENT>"),
    ("C2059: синтаксическая ошибка: @", "C2059: синтаксическая ошибка: <IDENT>"),
    ("C2059: синтаксическая ошибка: строка", "C2059: синтаксическая ошибка: <LITER>"),
    ('C2144: синтаксическая ошибка: перед "#" требуется ";"', "C2144: синтаксическая ошибка: перед <TYPE> требуется <TOKEN>"),
    ('C2187: синтаксическая ошибка: непредвиденный "@"', "C2187: синтаксическая ошибка: непредвиденный <IDENT>"),
    ('C1075: "{": не найдена соответствующая лексема', "C1075: <BRACE>: не найдена соответствующая лексема"),
    ("C2131: выражение не определяется константой", "C2131: выражение не определяется константой"),
    ("C2148: общий размер массива слишком велик", "C2148: общий размер массива слишком велик"),
    ("C2181: недопустимый else без соответствующего if", "C2181: недопустимый else без соответствующего if"),
    ('C2440: инициализация: невозможно преобразовать "#" в "int"', "C2440: <CONTEXT> невозможно преобразовать <TYPE_1> в <TYPE_2>"),
    ('C2446: ==: нет преобразования "#" в "int"', "C2446: <OPER>: нет преобразования <TYPE_1> в <TYPE_2>"),
    ('C2676: бинарный "+": "#" не определяет этот оператор', "C2676: бинарный <OPER>: <TYPE> не определяет этот оператор"),
    ('C2678: бинарный ">>": не найден оператор, принимающий левый операнд типа "#"', "C2678: бинарный <OPER>: не найден оператор, принимающий левый операнд типа <TYPE>"),
    ('C2679: бинарный "<<": не найден оператор, принимающий правый операнд типа "#"', "C2679: бинарный <OPER>: не найден оператор, принимающий правый операнд типа <TYPE>"),
    ("C2064: результатом фрагмента не является функция, принимающая 3 аргументов", "C2064: результатом фрагмента не является функция, принимающая <NUM> аргументов"),
    ("C1083: Не удается открыть файл включение: @.h: No such file or directory", "C1083: Не удается открыть файл включение: <PATH>"),
    ("C2106: =: левый операнд должен быть левосторонним значением", "C2106: <OPER>: левый операнд должен быть левосторонним значением"),
    ("C9999: @: другое", ""),
)


@query(f"SELECT event_id, {_case(tuple(after for _, after in _SAID))} AS said FROM events")
def t6_every_code(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("int", "const char *", "std::pair<int,int>", "Foo"))), (F.col("user_id") % 4 + 1).cast("int"))
    text = F.replace(F.replace(_pick(tuple(before for before, _ in _SAID)), F.lit("@"), F.concat(F.lit("имя_v"), F.col("user_id"))), F.lit("#"), kind)
    return events(spark, sf).select("event_id", D.normalize_error(text).alias("said"))


@query("SELECT event_id, CASE event_id % 2 WHEN 0 THEN '<<' END AS op FROM events")
def e6_operator_spelling(spark, sf):
    tokens = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("x"), F.lit("<<"), F.lit("+"))).otherwise(F.array(F.lit("x"), F.lit(";")))
    return events(spark, sf).select("event_id", X.operator_spelling(tokens).alias("op"))


@query("SELECT 1 AS id, 'a' AS name UNION ALL SELECT 2, 'b' UNION ALL SELECT 2, 'b'")
def u2_seed_relation(spark, sf):
    return S.seed_relation(spark, "SELECT 1 AS id, 'a' AS name", "SELECT 2, 'b'", "SELECT 2, 'b'")


@query("SELECT event_id AS row_id, CAST(event_id % 4 AS INTEGER) AS x FROM events")
def p4_without_label(spark, sf):
    rows = events(spark, sf).select(F.col("event_id").alias("row_id"), (F.col("event_id") % 4).cast("int").alias("x"), F.lit(1).alias("label"))
    return R.without(rows, "label")[0]


@query("SELECT event_id AS id, concat('bad ', CAST(user_id AS VARCHAR)) AS source_code FROM events WHERE event_id % 2 = 0 ORDER BY event_id LIMIT 200")
def e14_kept_samples(spark, sf):
    code = F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("bad ")).otherwise("good "), F.col("user_id"))
    made = events(spark, sf).select(F.col("event_id").alias("id"), code.alias("source_code"))
    fake = lambda s: b"x.cpp(1): error C2065: y: z" if s.startswith("bad") else b"ok"
    return R.kept_samples(made, fake, "C2065", 200).select("id", "source_code")


@query()
def plan_training_data(spark, sf):
    rows = submissions(spark, sf).drop("error_code")
    ctx = contexts(spark, sf)
    return training.build(rows, ctx, S.error_codes(spark), S.recommendations(spark))
