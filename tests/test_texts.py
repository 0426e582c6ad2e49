"""Hand-derived expectations for texts, types, diagnostics and predicates."""

import pytest
from pyspark.sql import functions as F

from emberlint.functions import diagnostics as D
from emberlint.functions import predicates as P
from emberlint.functions import text as X
from emberlint.functions import types as Y
from emberlint.functions import values as V


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "code, left",
    [
        ("int a; // c\nint b;", "int a; \nint b;"),
        ("a /* x\n y */ b", "a  b"),
        ('s = "// no" + 1; // yes', 's = "// no" + 1;'),
        ("c = '\\''; // q", "c = '\\'';"),
        ("a /* never closed", "a"),
        ('s = "open // still text', 's = "open // still text'),
        ("  x  ", "x"),
        ("", ""),
    ],
)
def test_comments(spark, code, left):
    assert one(spark, code, X.strip_comments) == left


@pytest.mark.parametrize(
    "said, normal",
    [
        ("C2065: x: undeclared", "C2065: <IDENT>: undeclared"),
        ("C3861: f: not found", "C3861: <FUNC>: not found"),
        ("C2672: f: none", "C2672: <FUNC>: none"),
        ('C2039: "a": not in "B"', "C2039: <IDENT>: not in <DECL>"),
        ('C2143: missing ";" before "константа"', "C2143: missing <TOKEN> before <LITER>"),
        ("C2059: синтаксическая ошибка: имя", "C2059: синтаксическая ошибка: <IDENT>"),
        ("C2059: синтаксическая ошибка: константа", "C2059: синтаксическая ошибка: <LITER>"),
        ('C2144: "int" before "x"', "C2144: <TYPE> before <TOKEN>"),
        ('C2187: "x" here', "C2187: <IDENT> here"),
        ('C1075: "{": none', "C1075: <BRACE>: none"),
        ("C2131: as it is", "C2131: as it is"),
        ('C2440: init: from "a" to "b"', "C2440: <CONTEXT> from <TYPE_1> to <TYPE_2>"),
        ('C2446: ==: from "a" to "b"', "C2446: <OPER>: from <TYPE_1> to <TYPE_2>"),
        ('C2676: "+": "Foo" no', "C2676: <OPER>: <TYPE> no"),
        ("C2064: принимающая 3 x", "C2064: принимающая <NUM> x"),
        ("C1083: no file: a.h: none", "C1083: no file: <PATH>"),
        ("C2106: =: left", "C2106: <OPER>: left"),
        ("C9999: x", ""),
        ("", ""),
    ],
)
def test_normalized(spark, said, normal):
    assert one(spark, said, D.normalize_error) == normal


def test_tokens(spark):
    assert one(spark, "C2065: x: необъявленный", D.error_tokens) == ["C2065", "<IDENT>", "необъявленный"]
    assert one(spark, None, D.error_tokens) == []


@pytest.mark.parametrize(
    "kind, category",
    [(None, "T_UNKNOWN"), ("", "T_UNKNOWN"), ("int &", "T_REF"), ("const char *", "T_PTR"), ("int [2]", "T_ARRAY"), ("void (int)", "T_FUNC"), ("std::map<int, int>", "T_TEMPLATE"), ("std::string", "T_STD"),
     ("a::b", "T_NAMESPACE"), ("void", "T_VOID"), ("const bool", "T_BOOL"), ("unsigned char", "T_CHAR"), ("long double", "T_FLOAT"), ("unsigned long long", "T_INT"), ("struct Foo", "T_USER")],
)
def test_categories(spark, kind, category):
    assert one(spark, kind, Y.type_category) == category


def test_windows(spark):
    df = spark.createDataFrame([("a\nb\nc", 1), ("a\nb\nc", 3), ("a\nb\nc", 9), ("", 1)], "s string, n int")
    got = [r[0] for r in df.select(X.line_window(F.col("s"), F.col("n"))).collect()]
    assert got == [["a", "b"], ["b", "c"], [], [""]]
    wide = [r[0] for r in df.select(X.wide_window(F.col("s"), F.lit(None).cast("int"))).collect()]
    assert wide[0] == ["a", "b", "c"]


def test_first_error(spark):
    def column(x):
        return F.struct(*X.first_error(x))

    assert tuple(one(spark, "a.cpp(3): warning\na.cpp(5): error C2065: x\nmore", column)) == ("C2065: x", 3)
    assert tuple(one(spark, " fine ", column)) == ("fine", None)
    assert tuple(one(spark, None, column)) == (None, None)


def test_output_encodings(spark):
    assert one(spark, bytearray("ошибка".encode()), X.decode_output, "binary") == "ошибка"
    assert one(spark, bytearray("ошибка".encode("cp866")), X.decode_output, "binary") == "ошибка"


@pytest.mark.parametrize(
    "test, line, ident, holds",
    [
        (P.type_like, "Foo x = 1;", "Foo", True), (P.type_like, "Foo return;", "Foo", False), (P.type_like, "vector<Foo> v;", "Foo", True), (P.type_like, "x = Foo;", "Foo", False),
        (P.control_like, "; retrun 0;", "retrun", True), (P.control_like, "x retrun", "retrun", False), (P.loop_like, "whlie (x)", "whlie", True), (P.loop_like, "whlie x", "whlie", False),
        (P.missing_separator_in_call, 'printf("%d" n);', "n", True), (P.missing_separator_in_call, "f(a b);", "b", True), (P.missing_separator_in_call, "if (a b)", "b", False),
        (P.missing_operator_in_condition, "if (a b) {", "b", True), (P.missing_operator_in_condition, "if (int b)", "b", False),
        (P.missing_comma_in_declaration, "int a b;", "b", True), (P.missing_comma_in_declaration, "int a = 1 b;", "b", True), (P.missing_comma_in_declaration, "a b;", "b", False),
    ],
)
def test_line_predicates(spark, test, line, ident, holds):
    df = spark.createDataFrame([(line, ident)], "a string, b string")
    assert df.select(test(F.col("a"), F.col("b"))).first()[0] is holds


@pytest.mark.parametrize(
    "test, line, holds",
    [
        (P.for_without_semicolons, "for (int i = 0, i < 3; i++)", True), (P.for_without_semicolons, "for (auto& x : v)", False), (P.for_without_semicolons, "for (;;)", False),
        (P.missing_shift, "cin a >> b;", True), (P.missing_shift, "cout << a b;", True), (P.missing_shift, 'cout << "x" c;', True), (P.missing_shift, 'cout<<"*" cout<<1;', False), (P.missing_shift, "cout << a;", False),
        (P.char_array, "const char [3]", True), (P.arithmetic_type, "size_t", True), (P.type_spelling, "==", False), (P.type_spelling, "ll", True),
    ],
)
def test_predicates(spark, test, line, holds):
    assert one(spark, line, test) is holds


def test_casts(spark):
    def cast(line, kind):
        df = spark.createDataFrame([(line, kind)], "a string, b string")
        return df.select(P.has_cast(F.col("a"), Y.cast_pattern(F.col("b")))).first()[0]

    assert cast("x = (int) y;", "int") and cast("x = static_cast<int>(y);", "int") and cast("int(y)", "int")
    assert cast("x = (char *) y;", "char *") and cast("(unsigned int)y", "unsigned int") and cast("(long long)x", "ll")
    assert not cast("sizeof(int)", "int") and not cast("x = y;", "int")


def test_types_of_names(spark):
    assert one(spark, "const std::pair<int,int> &", Y.outer_type) == "std::pair"
    assert one(spark, "const volatile Foo", lambda x: Y.outer_and_qualifiers(x)[1]) == ["const", "volatile"]


def test_standard_functions():
    names = V.std_functions(("mine",))
    assert {"sqrt", "printf", "sort", "mine"} <= set(names) and len(names) == len(set(names))
