"""Guards, labels, contexts, matrices, models and streams."""

import json

import pytest
from pyspark.sql import functions as F

from emberlint.operators import boundary as B
from emberlint.operators import contexts as C
from emberlint.operators import labeling as L
from emberlint.operators import matrix as M
from emberlint.operators import models
from emberlint.operators import rows as R
from emberlint.plans import training
from emberlint.sources import tables as S
from emberlint.streaming import streams

ROWS = "row_id long, error_code string, error_text string, source_code string, error_line int"


def labels(spark, *rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], ROWS)
    return [r["label_code"] for r in L.apply_labels(df).orderBy("row_id").collect()]


def test_labels(spark):
    assert labels(
        spark,
        ("C2065", "C2065: cout: x", "cout << 1;", 1),
        ("C2065", "C2065: retrun: x", "int f() {\n retrun 0;\n}", 2),
        ("C2065", "C2065: conut: x", "int count2 = 1;\nint counter;\nx = conut;\nint count1;", 3),
        ("C2065", "C2065: zzz: x", "int a;", 1),
        ("C3861", "C3861: prinft: x", "prinft(1);", 1),
        ("C2146", 'C2146: перед идентификатором "b"', "f(a b);", 1),
        ("C2146", 'C2146: перед идентификатором "b"', "x = 1", 1),
        ("C2676", 'C2676: бинарный "+": "std::stack<int>" нет', "s + 1", 1),
        ("C1083", "C1083: a: b", "", None),
        (None, None, None, None),
    ) == [
        "HEADER_OR_STD_NAMESPACE", "FIX_NAME_SPELLING", "FIX_NAME_SPELLING", "DECL_BEFORE_USE", "FIX_NAME_SPELLING", "INCORRECT_CONSTRUCTION_OR_SYMBOLS",
        "MISSING_SEMICOLON_BEFORE", "FIX_EXPR_FOR_OPERATOR", "INCORRECT_FILE_INCLUDE", None,
    ]


@pytest.mark.parametrize(
    "label, code, text, line, want",
    [
        (L.failing_cast, "C2440", 'C2440: x: невозможно преобразовать "a" в "int"', "x = (int) y;", "FIX_CAST"),
        (L.failing_cast, "C2440", 'C2440: x: невозможно преобразовать "a" в "int"', "x = y;", None),
        (L.pointer_comparison, "C2446", 'C2446: ==: нет "int" в "char *"', "if (s == 3)", "FIX_POINTERS_FOR_CAST"),
        (L.pointer_comparison, "C2446", 'C2446: ==: нет "int" в "char *"', "if (s == NULL)", None),
        (L.left_operand, "C2678", 'C2678: бинарный "=": нет операнда типа "const Foo"', "a = b", "FIX_LEFT_OPERAND"),
        (L.left_operand, "C2678", 'C2678: бинарный "+": нет операнда типа "Foo"', "a + b", None),
        (L.right_operand, "C2679", 'C2679: бинарный "<<": нет операнда типа "void"', "cout << f()", "FIX_RIGHT_OPERAND"),
        (L.right_operand, "C2679", 'C2679: бинарный ">>": нет операнда типа "const int"', "cin >> x", "FIX_RIGHT_OPERAND"),
        (L.right_operand, "C2679", 'C2679: бинарный "+": нет операнда типа "Foo"', "a + b", None),
    ],
)
def test_labels_not_in_use(spark, label, code, text, line, want):
    df = spark.createDataFrame([(0, code, text, line, 1)], ROWS)
    assert df.select(label()).first()[0] == want


def test_one_to_one(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "row_id long, a string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "row_id long, b string")
    assert R.one_to_one(a, a.withColumnRenamed("a", "b"), "row_id").count() == 2
    with pytest.raises(Exception, match="repeated row_id"):
        R.one_to_one(a, b, "row_id").collect()


def test_updates(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "row_id long, ctx string")
    new = spark.createDataFrame([(2, "z"), (9, "w")], "row_id long, ctx string")
    assert sorted(map(tuple, R.updated(a, new, "row_id", "ctx").select("row_id", "ctx").collect())) == [(1, "x"), (2, "z")]
    assert R.unknown_keys(a, new, "row_id").count() == 1
    with pytest.raises(ValueError):
        R.updated(a, new.select("ctx"), "row_id", "ctx")


def test_merged_contexts(spark):
    a = spark.createDataFrame([(1, "x")], "row_id long, ctx string")
    assert R.merge_contexts(a, spark.createDataFrame([(2, "y")], a.schema)).count() == 2
    for other in ([(1, "y")], [(3, None)]):
        with pytest.raises(Exception, match="repeated|missing"):
            R.merge_contexts(a, spark.createDataFrame(other, a.schema)).collect()


def test_samples(spark):
    made = R.generated_samples(spark.range(50).withColumnRenamed("id", "id"), "int <A> = <B>;", {"A": ["x", "y"], "B": ["1", "2"]})
    assert {r.source_code for r in made.collect()} <= {f"int {a} = {b};" for a in "xy" for b in "12"}
    kept = R.insertable(made, made.limit(1), ["hash"], ["source_code"])
    assert kept.count() == made.count() - 1


def test_context_files(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"row_id": 1, "ctx": {"line": 3, "includes": ["map"]}}\n\n{"row_id": 2, "ctx": {}}\n')
    df = S.read_contexts(spark, str(path))
    good, bad = C.split_empty(df)
    assert [r.row_id for r in good.collect()] == [1] and [r.row_id for r in bad.collect()] == [2]
    tokens, numbers = C.context_columns(F.col("ctx"))
    rows = {r.row_id: (r.t, r.n) for r in df.select("row_id", tokens.alias("t"), numbers.alias("n")).collect()}
    assert json.loads(rows[1][0]) == ["F_INC__CAT=CONTAINER"] and json.loads(rows[1][1])["N_INC__INCLUDES"] == 1.0
    assert rows[2] == (None, None)
    S.write_json_lines(df, str(tmp_path / "out"))
    assert S.read_contexts(spark, str(tmp_path / "out")).count() == 2


def test_full_context(spark):
    ctx = {"line": 1, "core_info": {"kind": "CALL", "is_expr": True, "type": "int", "result_type": "void"}, "cursor_meta": {"op_spelling": "+", "lhs_type": "int", "rhs_type": "Foo", "num_args": 5, "arg_types": ["int", "char", "bool", "a::b", "x"], "ref_kind": "R", "ref_type": "int *", "is_type_ref": True},
           "parent_chain": ["A", "A"], "macros": [{"kind": "macro_def"}, {"kind": "macro_use"}], "aliases_ns": {"using_directives": ["std", "std"], "typedefs": [{"underlying": "int"}, {"underlying": "int"}]}}
    df = spark.createDataFrame([(json.dumps(ctx),)], "s string").select(F.from_json("s", S.CTX_SCHEMA).alias("ctx"))
    tokens, numbers = C.context_features(F.col("ctx"))
    t, n = df.select(tokens, numbers).first()
    assert t == ["F_CORE__KIND=CALL", "F_CORE__TYPE_CAT=T_INT", "F_CORE__RESULT_TYPE_CAT=T_VOID", "F_META__BINOP_OP=+", "F_META__BINOP_LHS_CAT=T_INT", "F_META__BINOP_RHS_CAT=T_USER", "F_META__CALL_ARG0_CAT=T_INT", "F_META__CALL_ARG1_CAT=T_CHAR",
                 "F_META__CALL_ARG2_CAT=T_BOOL", "F_META__CALL_ARG3_CAT=T_NAMESPACE", "F_META__CALL_ARGS_GT4", "F_META__REF_KIND=R", "F_META__REF_TYPE_CAT=T_PTR", "F_PARENT__D0=A", "F_PARENT__D1=A", "F_PARENT__KIND=A", "F_USING_NS__NS=std", "F_TYPEDEF__UNDER_CAT=T_INT"]
    assert n["N_META__CALL_N_ARGS"] == 5 and n["N_MACRO__DEF"] == 1 and n["N_TYPEDEF__UNDER__T_INT"] == 2 and n["N_USING__DIRECTIVES"] == 2 and n["N_META__IS_TYPE_REF"] == 1
    assert "N_DECL__HAS_STRUCT" not in n and n["N_DECL__VARS_TOTAL"] == 0


def test_tfidf_rows_have_length_one(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"])], "id long, t array<string>")
    w = M.tfidf(M.term_counts(df, "id", F.col("t")), "id", 2)
    assert all(abs(r.s - 1) < 1e-9 for r in w.groupBy("id").agg(F.sum(F.col("value") ** 2).alias("s")).collect())
    h = M.hashed_counts(df, "id", F.col("t"), signed=True)
    assert h.where("id = 1").count() == 2
    both = M.assembled(a=w, b=M.max_abs_scaled(M.term_counts(df, "id", M.ngrams(F.col("t"), 1, 3))))
    assert both.where("term = 'b:a b a'").count() == 1


def test_models(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector

    df = spark.range(60).withColumn("label", (F.col("id") % 2).cast("double")).withColumn("features", array_to_vector(F.array((F.col("label") + 0.1 * (F.col("id") % 3)).cast("double"), F.lit(1.0))))
    df = models.balanced(df.withColumnRenamed("id", "row_id"), "label")
    model, best = models.tuned(df, "logistic", {"regParam": [0.01, 0.1], "maxIter": [20]}, folds=2)
    assert models.accuracy(model.transform(df)) == 1.0 and best["maxIter"] == 20
    models.save_bundle(model, str(tmp_path / "m"), spark, best=best)
    again, meta = models.load_bundle(str(tmp_path / "m"), spark, strict=True)
    assert meta["best"] == best and models.accuracy(again.transform(df)) == 1.0
    with pytest.raises(ValueError):
        models.tuned(df, "logistic", {}, method="other")
    folds = R.stratified_folds(df, "label", "row_id", k=2)
    assert models.out_of_fold(folds, "logistic", {"maxIter": 5}, k=2).count() == 60


def test_compiler_and_contexts(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "row_id long, source_code string")
    got = {r.row_id: (r.error_text, r.error_line) for r in B.compiled(df, lambda s: b"x.cpp(4): error C2065: y: z" if s == "bad" else b"ok").collect()}
    assert got == {1: ("ok", None), 2: ("C2065: y: z", 4), 3: (None, None)}

    def extract(source, line, with_macros):
        if source == "bad":
            raise RuntimeError("no")
        return {"line": line, "includes": ["map"]}

    rows = df.where("source_code is not null").withColumn("error_line", F.lit(2))
    made = {r.row_id: r.ctx for r in B.with_contexts(rows, extract).collect()}
    assert made[1].includes == ["map"] and made[2].includes is None


def test_cursors(spark):
    cursors = spark.createDataFrame([("f", 1, 0, 9, "A"), ("f", 1, 1, 3, "B"), ("f", 1, 2, 3, "C")], "file string, line int, ordinal int, length int, kind string")
    assert B.nearest_cursor(cursors).first().kind == "B"
    tree = spark.createDataFrame([("f", 1, None, "ROOT"), ("f", 2, 1, "FN"), ("f", 3, 2, "IF")], "file string, id int, parent int, kind string")
    assert {r.id: r.chain for r in B.parent_chain(tree).collect()} == {1: [], 2: ["ROOT"], 3: ["FN", "ROOT"]}


def test_training_plan(spark):
    subs = spark.createDataFrame([(1, "C2065: cout: x", 1, "cout << 1;"), (2, "fine", None, "")], "row_id long, error_text string, error_line int, source_code string")
    ctx = spark.createDataFrame([(1, '{"line": 1, "includes": ["map"]}')], "row_id long, s string").select("row_id", F.from_json("s", S.CTX_SCHEMA).alias("ctx"))
    rows = training.build(subs, ctx, S.error_codes(spark), S.recommendations(spark)).collect()
    assert [(r.label, json.loads(r.error_text_tokens)) for r in rows] == [(3, ["C2065", "<IDENT>", "x"])]


def test_training_rows_move_before_labels(spark):
    """Rows are dealt evenly by their key, and nothing moves by a key above Python's step, of which there is one."""
    subs = spark.createDataFrame([(1, "C2065: cout: x", 1, "cout << 1;")], "row_id long, error_text string, error_line int, source_code string")
    ctx = spark.createDataFrame([(1, "{}")], "row_id long, s string").select("row_id", F.from_json("s", S.CTX_SCHEMA).alias("ctx"))
    plan = training.build(subs, ctx, S.error_codes(spark), S.recommendations(spark))._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("ArrowEvalPython")
    assert "hashpartitioning(" not in above
    assert "REPARTITION_BY_NUM" in below


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, 3), (2, 99)], "row_id long, label int")
    df.write.parquet(str(tmp_path / "in"))
    stream = streams.recommended(streams.read_submissions(spark, str(tmp_path / "in"), "row_id long, label int"), S.recommendations(spark))
    q = stream.writeStream.format("memory").queryName("recommended").start()
    q.processAllAvailable()
    q.stop()
    assert {r.row_id: r.recommendation for r in spark.table("recommended").collect()} == {1: "C2065: HEADER_OR_STD_NAMESPACE", 2: "no recommendation"}


def test_tuning(spark):
    df = spark.range(90).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("double").alias("label"), F.array((F.col("id") % 2).cast("double"), F.lit(1.0)).alias("x"))
    entries = df.select("row_id", F.posexplode("x").alias("index", "value"))
    ready = models.balanced(df.join(models.as_vectors(entries, "row_id", None, 3, df.select("row_id")), "row_id"), "label")
    assert ready.first().features.size == 3
    grid = {"regParam": [0.01, 0.1, 1.0], "maxIter": [5, 10]}
    assert models.tuned(ready, "logistic", grid, method="random", n_iter=1, folds=2)[1]["regParam"] in grid["regParam"]
    assert models.tuned(ready, "logistic", {"regParam": [0.01, 0.1], "maxIter": [2, 10]}, method="halving_grid", folds=2, resource="maxIter", scorer="f1_macro")[1]["maxIter"] == 10
    for wrong in ({"method": "halving_random", "resource": "tol"}, {"scorer": "other"}, {"method": "halving_grid", "scorer": ["accuracy", "f1_macro"]}):
        with pytest.raises(ValueError):
            models.tuned(ready, "logistic", grid, **wrong)


def test_term_index(spark, tmp_path):
    df = spark.createDataFrame([(t,) for t in ["b", "a", "é", "a", None, "c b"]], "term string")
    got = {r["term"]: r["index"] for r in models.term_index(df, str(tmp_path / "terms")).collect()}
    assert got == {"a": 0, "b": 1, "c b": 2, "é": 3}


def test_labels_against_each_function(spark):
    from emberlint.operators import labeling as L

    rows = [(1, "C2065", "C2065: cout: x", "cout << 1;"), (2, "C2065", "C2065: retrun: x", "retrun 0;"), (3, "C3861", "C3861: myfnu: x", "myfun(1); myfnu(2);"), (4, "C3861", "C3861: zzz: x", "zzz(1);"),
            (5, "C2146", 'C2146: отсутствие ";" перед идентификатором "b"', "f(a b);"), (6, "C1083", "C1083: x", "y"), (7, None, None, None)]
    df = spark.createDataFrame(rows, "row_id int, error_code string, error_text string, source_code string").withColumn("error_line", F.lit(1))
    got = {r.row_id: r.label_code for r in L.apply_labels(df).collect()}
    assert got == {1: "HEADER_OR_STD_NAMESPACE", 2: "FIX_NAME_SPELLING", 3: "FIX_NAME_SPELLING", 4: "DECL_BEFORE_USE", 5: "INCORRECT_CONSTRUCTION_OR_SYMBOLS", 6: "INCORRECT_FILE_INCLUDE", 7: None}


def test_first_entry():
    from emberlint.sources.tables import first_entry

    assert first_entry([{"a": 1}, {"a": 2, "b": 3}, {"a": 2}], "a", 2) == {"a": 2, "b": 3} and first_entry([], "a", 1) is None


def test_terms_do_not_move(spark):
    """Counting n-grams shuffles rows by their key alone; weights shuffle no counts by term or by row while terms are few. Repeated keys meet, null terms count."""
    df = spark.createDataFrame([(1, ["b", "a", None, "b"]), (1, ["a"]), (None, ["x"]), (None, ["x"]), (2, []), (3, None)], "id int, t array<string>")
    counts = M.term_counts(df, "id", F.col("t"))
    assert {(r.id, r.term, r.value) for r in counts.collect()} == {(1, "a", 2.0), (1, "b", 2.0), (1, None, 1.0), (None, "x", 2.0)}
    for found in (counts, M.tfidf(counts, "id", 4)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        moved = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line]
        assert moved and all(keys.startswith("id#") and "term" not in keys for keys in moved)
