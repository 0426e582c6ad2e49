"""Queries on the structure of programs, which are varied ones from the events table, and on positions in an order."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlint.operators import structure as P
from emberlint.operators.positions import OrderIndex
from emberlint.queries import _view, events, query
from emberlint.sources.tables import scratch_path

C = F.col
_OPS = ("+", "*", "<<", "<", "==", "&", "&&", "=")
_TIGHT = (11, 12, 10, 9, 8, 7, 4, 1)
_case = lambda x, values: f"CASE {x} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"
_text = lambda values: [f"'{v}'" for v in values]
#: A program for each event: types, names, operators and headers vary; the same text in both engines.
_PARTS = f"""
SELECT event_id, event_id % 5 = 0 AS limited, CAST(CASE event_id % 4 WHEN 0 THEN 6 WHEN 1 THEN 8 WHEN 2 THEN 9 ELSE 10 END AS INT) AS error_line,
  {_case("user_id % 3", _text(("int", "double", "ll")))} AS t, concat('f', CAST(user_id AS STRING)) AS f, concat('n', CAST(user_id AS STRING)) AS n,
  {_case("event_id % 3", _text(("vector", "map", "sys/own.h")))} AS header,
  {_case("event_id % 8", _text(_OPS))} AS op1, {_case("user_id % 8", _text(_OPS))} AS op2, {_case("event_id % 8", _TIGHT)} AS p1, {_case("user_id % 8", _TIGHT)} AS p2
FROM events
"""
_LINES = (
    "'#include <', header, '>'", "CASE WHEN limited THEN '#define LIMIT 10' ELSE '// no limit' END", "'using namespace std;'", "'typedef long long ll;'", "'struct Node { int key; Node *next; };'",
    "t, ' ', f, '(', t, ' x, const vector<int> &ys) {'", "'  Node ', n, '; ', t, ' v = x;'", "'  for (int i = 0; i < 9; i++) { ', t, ' v = i; ', n, '.key += v; }'",
    "CASE WHEN limited THEN '  v = v * LIMIT;' ELSE '  v = sqrt(v);' END", "'  return 1 ', op1, ' 2 ', op2, ' 3;'", "'}'",
)
_PROGRAMS = f"SELECT event_id, error_line, concat({', chr(10), '.join(_LINES)}) AS source_code FROM ({_PARTS}) p"
_T = "CASE t WHEN 'int' THEN 'INT' WHEN 'double' THEN 'DOUBLE' ELSE '<ID_TYPE_ALIAS_USE>' END"
_D, _U = "<ID_VAR_SCALAR_DECL>", "<ID_VAR_SCALAR_USE>"
_CLASSES = (
    "'<PP_INCLUDE>'", "CASE WHEN limited THEN ' <PP_DEFINE> <MACRO_NAME_USE>' ELSE '' END", "' USING NAMESPACE <ID_IDENT> ; TYPEDEF LONG LONG <ID_TYPE_ALIAS_DECL> ;'",
    f"' STRUCT <ID_IDENT> {{ INT {_D} ; <ID_TYPE_USER_USE> OP_* <ID_VAR_PTR_DECL> ; }} ; '", _T, "' <ID_FUNC_DECL> ( '", _T, f"' {_D} OP_, CONST <ID_IDENT> OP_< INT OP_> OP_& {_D} ) {{'",
    "' <ID_TYPE_USER_USE> <ID_VAR_OBJ_DECL> ; '", _T, f"' {_D} OP_= {_U} ; FOR ( INT {_D} OP_= <NUM> ; {_U} OP_< <NUM> ; {_U} OP_++ ) {{ '", _T, f"' {_D} OP_= {_U} ; <ID_VAR_OBJ_USE> OP_. <ID_IDENT> OP_+= {_U} ; }} '",
    f"CASE WHEN limited THEN '{_U} OP_= {_U} OP_* <MACRO_NAME_USE> ;' ELSE '{_U} OP_= <ID_FUNC_USE_LIB> ( {_U} ) ;' END", "' RETURN <NUM> OP_', op1, ' <NUM> OP_', op2, ' <NUM> ; }'",
)


def programs(spark, sf):
    return _view(spark, sf, _PROGRAMS)


@query(f"SELECT event_id, concat({', '.join(_CLASSES)}) AS classes FROM ({_PARTS}) p")
def e8_every_class(spark, sf):
    key = "event_id"
    each, members = P.alike(programs(spark, sf), key)
    toks = P.written(P.tokens(each, key), "query-tokens")
    index = P.written(P.nested(toks, key), "query-brackets")
    found = P.written(P.nodes(P.statements(index, key), key), "query-statements")
    classed = P.token_classes(toks, P.resolved(index, P.declarations(found, key), key), key, with_macros=True)
    listed = classed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "class"))).alias("z"))
    told = listed.select(F.col(key).alias("of"), F.array_join(F.transform("z", lambda x: x["class"]), " ").alias("classes"))
    return members.join(told, "of").select(key, "classes")


#: The tighter of the two operators of the last line; of equally tight ones the first, but the second of two assignments.
_FIRST = "(p1 > p2 OR (p1 = p2 AND p1 > 1))"


@query(
    f"SELECT event_id, CASE WHEN {_FIRST} THEN op1 ELSE op2 END AS op, CASE WHEN {_FIRST} THEN '1 : 2' ELSE '2 : 3' END AS inner_sides,"
    f" CASE WHEN {_FIRST} THEN op2 ELSE op1 END AS outer_op, CASE WHEN {_FIRST} THEN concat('1 ', op1, ' 2 : 3') ELSE concat('1 : 2 ', op2, ' 3') END AS outer_sides FROM ({_PARTS}) p"
)
def e10_operand_spans(spark, sf):
    key = "event_id"
    each, members = P.alike(programs(spark, sf), key)
    found = P.written(P.nodes(P.statements(P.nested(P.tokens(each, key), key), key), key), "query-statements")
    parts = P.expressions(found, P.declarations(found, key), key)
    told = P.operators(parts, key).where("line = 10").withColumn("size", C("hi") - C("lo"))
    spans = F.struct("op", "lhs_lo", "lhs_hi", "rhs_lo", "rhs_hi")
    one = told.groupBy(C(key).alias("of")).agg(F.min_by(spans, "size").alias("i"), F.max_by(spans, "size").alias("o"))
    # Spans are the same in all programs that are equal up to names: each cuts its sides out of its own text.
    met = members.join(P.written(one, "query-spans"), "of")
    side = lambda x: F.substring("source_code", C(f"{x}_lo") + 1, C(f"{x}_hi") - C(f"{x}_lo") + 1)
    sides = lambda n: F.concat(side(f"{n}.lhs"), F.lit(" : "), side(f"{n}.rhs"))
    return met.select(key, C("i.op").alias("op"), sides("i").alias("inner_sides"), C("o.op").alias("outer_op"), sides("o").alias("outer_sides"))


_ALIASED = "t = 'll' AND error_line = 6"
_CTX_SQL = f"""
SELECT event_id, error_line,
  CASE error_line WHEN 6 THEN CASE WHEN t = 'll' THEN 'TYPE_REF' ELSE 'PARM_DECL' END WHEN 8 THEN 'VAR_DECL' WHEN 9 THEN 'DECL_REF_EXPR' ELSE 'BINARY_OPERATOR' END AS kind,
  CASE error_line WHEN 6 THEN CASE WHEN t = 'll' THEN 'll' ELSE 'x' END WHEN 8 THEN 'i' WHEN 9 THEN 'v' ELSE '' END AS spelling,
  CASE error_line WHEN 6 THEN CASE WHEN t = 'll' THEN 'long long' ELSE t END WHEN 8 THEN 'int' WHEN 9 THEN t END AS type,
  CASE error_line WHEN 6 THEN 'FUNCTION_DECL' WHEN 8 THEN 'FOR_STMT COMPOUND_STMT FUNCTION_DECL' WHEN 9 THEN 'BINARY_OPERATOR COMPOUND_STMT FUNCTION_DECL'
    ELSE 'BINARY_OPERATOR RETURN_STMT COMPOUND_STMT FUNCTION_DECL' END AS chain,
  CASE WHEN error_line = 10 THEN CASE WHEN {_FIRST} THEN op1 ELSE op2 END END AS op, CASE WHEN error_line = 10 THEN 'INTEGER_LITERAL INTEGER_LITERAL int int' END AS sides,
  CASE WHEN {_ALIASED} THEN 'TYPEDEF_DECL' WHEN error_line = 9 THEN 'VAR_DECL' END AS ref_kind,
  CASE header WHEN 'sys/own.h' THEN 'own.h' ELSE header END AS includes, CASE WHEN limited THEN 'macro_def 2, macro_use 9' END AS macros, 'std' AS usings, 'll = long long' AS typedefs,
  CASE t WHEN 'int' THEN 'FIELD_DECL 2, PARM_DECL 2, VAR_DECL 4; Node 1, Node * 1, const vector<int> & 1, int 5'
    WHEN 'double' THEN 'FIELD_DECL 2, PARM_DECL 2, VAR_DECL 4; Node 1, Node * 1, const vector<int> & 1, double 3, int 2'
    ELSE 'FIELD_DECL 2, PARM_DECL 2, VAR_DECL 4; Node 1, Node * 1, const vector<int> & 1, int 2, ll 3' END AS variables, 'STRUCT_DECL 1; FUNCTION_DECL 1' AS kinds
FROM ({_PARTS}) p
"""


@query(_CTX_SQL)
def e11_contexts(spark, sf):
    rows = P.contexts(programs(spark, sf), "event_id", with_macros=True)
    c = lambda x: F.col(f"ctx.{x}")
    entries = lambda x: F.array_join(F.transform(F.array_sort(F.map_entries(c(f"decls.{x}"))), lambda e: F.concat_ws(" ", e["key"], e["value"])), ", ")
    return rows.select(
        "event_id", "error_line", c("core_info.kind").alias("kind"), c("core_info.spelling").alias("spelling"), c("core_info.type").alias("type"), F.array_join(c("parent_chain"), " ").alias("chain"),
        c("cursor_meta.op_spelling").alias("op"), F.when(c("cursor_meta.op_spelling").isNotNull(), F.concat_ws(" ", *(c(f"cursor_meta.{x}") for x in ("lhs_kind", "rhs_kind", "lhs_type", "rhs_type")))).alias("sides"),
        c("cursor_meta.ref_kind").alias("ref_kind"), F.array_join(c("includes"), " ").alias("includes"), F.array_join(F.transform(c("macros"), lambda m: F.concat_ws(" ", m["kind"], m["line"])), ", ").alias("macros"),
        F.array_join(c("aliases_ns.using_directives"), " ").alias("usings"), F.array_join(F.transform(c("aliases_ns.typedefs"), lambda t: F.concat(t["name"], F.lit(" = "), t["underlying"])), ", ").alias("typedefs"),
        F.concat(entries("var_kind_counts"), F.lit("; "), entries("var_type_counts")).alias("variables"), F.concat(entries("type_kind_counts"), F.lit("; "), entries("func_kind_counts")).alias("kinds"),
    )


def _by_user(spark, sf) -> OrderIndex:
    return OrderIndex.build(events(spark, sf).select("event_id", "user_id"), scratch_path(spark, "query-positions"), "user_id", "event_id", ranges=32)


@query("SELECT event_id, user_id, position FROM (SELECT event_id, user_id, row_number() OVER (ORDER BY user_id NULLS FIRST, event_id) - 1 AS position FROM events) p WHERE position BETWEEN 300 AND 449")
def p1_indexed_slice(spark, sf):
    return _by_user(spark, sf).slice(300, 450)


@query("SELECT event_id, position, CAST(position // 64 AS BIGINT) AS batch FROM (SELECT event_id, row_number() OVER (ORDER BY user_id NULLS FIRST, event_id) - 1 AS position FROM events) p")
def n7_indexed_batches(spark, sf):
    return _by_user(spark, sf).batches(64).select("event_id", "position", "batch")
