"""Syntactic contexts: emptiness, pruning, and their token and numeric features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlint.functions.text import once
from emberlint.functions.types import header_category, type_category

_TEXTS = "array<string>"


def pruned(x: Column, kind: T.DataType) -> Column:
    """Null for whatever holds nothing: nulls, empty arrays and maps, structs of such; scalars stay."""
    if isinstance(kind, T.StructType):
        parts = [pruned(x[f.name], f.dataType).alias(f.name) for f in kind.fields]
        some = F.lit(False)
        for p in parts:
            some = some | p.isNotNull()
        return F.when(some, F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        inner = F.filter(F.transform(x, lambda v: pruned(v, kind.elementType)), lambda v: v.isNotNull())
        return F.when(F.size(inner) > 0, inner)
    if isinstance(kind, T.MapType):
        inner = F.map_filter(F.transform_values(x, lambda k, v: pruned(v, kind.valueType)), lambda k, v: v.isNotNull())
        return F.when(F.size(inner) > 0, inner)
    return x


def is_empty(x: Column, kind: T.DataType) -> Column:
    return pruned(x, kind).isNull()


def cleaned(df: DataFrame, column: str = "ctx") -> DataFrame:
    return df.withColumn(column, pruned(F.col(column), df.schema[column].dataType))


def split_empty(df: DataFrame, column: str = "ctx") -> tuple[DataFrame, DataFrame]:
    """(rows with a context, rows whose context holds nothing)."""
    flagged = df.withColumn("_empty", is_empty(F.col(column), df.schema[column].dataType))
    return flagged.where("not _empty").drop("_empty"), flagged.where("_empty").drop("_empty")


def _list(x: Column) -> Column:
    return F.coalesce(x, F.array().cast(_TEXTS))


def _named(prefix: str, xs: Column) -> Column:
    return F.transform(xs, lambda v: F.concat(F.lit(prefix), v))


def _maybe(prefix: str, x: Column, value: Column | None = None) -> Column:
    """A token if ``x`` holds a text."""
    said = F.concat(F.lit(prefix), x if value is None else value)
    return F.when(x.isNotNull() & (x != ""), F.array(said)).otherwise(F.array().cast(_TEXTS))


def _flag(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit(False)), 1.0).otherwise(0.0)


def _has(x: Column) -> Column:
    return _flag(x.isNotNull() & (x != ""))


def _numbers(**named: Column) -> Column:
    pairs = [v for k, x in named.items() for v in (F.lit(k), x.cast("double"))]
    return F.create_map(*pairs)


def _sizes(x: Column) -> Column:
    return F.greatest(F.size(x), F.lit(0))


def _total(m: Column) -> Column:
    return F.coalesce(F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, v: a + v), F.lit(0).cast("long"))


def _by_category(entries: Column) -> Column:
    """Map of category to sum, categories in order of appearance, from an array of (category, n)."""
    summed = lambda of, c: F.aggregate(of, F.lit(0).cast("long"), lambda a, e: a + F.when(e["cat"] == c, e["n"]).otherwise(0))
    kinds = lambda of: F.array_distinct(F.transform(of, lambda e: e["cat"]))
    return once(entries, lambda of: once(kinds(of), lambda ks: F.map_from_arrays(ks, F.transform(ks, lambda c: summed(of, c)))))


def _prefixed(prefix: str, m: Column) -> Column:
    empty = F.create_map().cast("map<string,double>")
    return F.coalesce(F.transform_values(F.transform_keys(m, lambda k, v: F.concat(F.lit(prefix), k)), lambda k, v: v.cast("double")), empty)


def _categories(ctx: Column) -> Column:
    """(typedefs, variables): maps of a context's categories to how many."""
    under = F.transform(_typedefs(ctx), lambda t: F.struct(type_category(t["underlying"]).alias("cat"), F.lit(1).cast("long").alias("n")))
    typed = F.coalesce(F.map_entries(ctx["decls"]["var_type_counts"]), F.array().cast("array<struct<key:string,value:bigint>>"))
    variables = F.transform(typed, lambda e: F.struct(type_category(e["key"]).alias("cat"), e["value"].alias("n")))
    return F.struct(_by_category(under).alias("typedefs"), _by_category(variables).alias("variables"))


def _typedefs(ctx: Column) -> Column:
    return F.coalesce(ctx["aliases_ns"]["typedefs"], F.array().cast("array<struct<name:string,underlying:string,kind:string>>"))


def _tokens(ctx: Column, categories: Column) -> Column:
    core, meta, alias = ctx["core_info"], ctx["cursor_meta"], ctx["aliases_ns"]
    local, parents, includes = _list(ctx["local_tokens_norm"]), _list(ctx["parent_chain"]), _list(ctx["includes"])
    arguments = _list(meta["arg_types"])
    none = F.array().cast(_TEXTS)
    of_core = F.when(
        core.isNotNull(),
        F.concat(
            _maybe("F_CORE__KIND=", core["kind"]),
            F.array(F.concat(F.lit("F_CORE__TYPE_CAT="), type_category(core["type"]))),
            _maybe("F_CORE__RESULT_TYPE_CAT=", core["result_type"], type_category(core["result_type"])),
        ),
    ).otherwise(none)
    of_meta = F.concat(
        _maybe("F_META__BINOP_OP=", meta["op_spelling"]),
        _maybe("F_META__BINOP_LHS_CAT=", meta["lhs_type"], type_category(meta["lhs_type"])),
        _maybe("F_META__BINOP_RHS_CAT=", meta["rhs_type"], type_category(meta["rhs_type"])),
        F.transform(F.slice(arguments, 1, 4), lambda t, i: F.concat(F.lit("F_META__CALL_ARG"), i.cast("string"), F.lit("_CAT="), type_category(t))),
        F.when(F.size(arguments) > 4, F.array(F.lit("F_META__CALL_ARGS_GT4"))).otherwise(none),
        _maybe("F_META__REF_KIND=", meta["ref_kind"]),
        _maybe("F_META__REF_TYPE_CAT=", meta["ref_type"], type_category(meta["ref_type"])),
    )
    return F.concat(
        _named("F_TOK=", local),
        of_core,
        of_meta,
        F.transform(parents, lambda p, i: F.concat(F.lit("F_PARENT__D"), i.cast("string"), F.lit("="), p)),
        _named("F_PARENT__KIND=", F.array_distinct(parents)),
        _named("F_INC__CAT=", F.array_distinct(F.filter(F.transform(includes, header_category), lambda c: c.isNotNull()))),
        _named("F_USING_NS__NS=", F.array_distinct(_list(alias["using_directives"]))),
        _named("F_TYPEDEF__UNDER_CAT=", F.map_keys(categories["typedefs"])),
        _named("F_DECL__VARS_TYPE_CAT=", F.map_keys(categories["variables"])),
    )


def _numeric(ctx: Column, categories: Column) -> Column:
    core, meta, alias = ctx["core_info"], ctx["cursor_meta"], ctx["aliases_ns"]
    parents, includes, decls, macros = _list(ctx["parent_chain"]), _list(ctx["includes"]), ctx["decls"], ctx["macros"]
    local = _list(ctx["local_tokens_norm"])
    empty = F.create_map().cast("map<string,double>")
    macro = lambda kind: F.size(F.filter(macros, lambda m: m["kind"] == kind))
    has_core, has_macros = core.isNotNull(), F.coalesce(F.size(macros) > 0, F.lit(False))
    kinds = decls["type_kind_counts"]
    has_kind = lambda k: F.coalesce(F.map_contains_key(kinds, k), F.lit(False))
    return F.map_concat(
        _numbers(N_TOK__LOCAL_TOK_LEN=F.size(local), N_CORE__HAS_CORE_INFO=_flag(has_core)),
        F.when(
            has_core,
            _numbers(
                N_CORE__IS_DECL=_flag(core["is_decl"]), N_CORE__IS_EXPR=_flag(core["is_expr"]), N_CORE__IS_STMT=_flag(core["is_stmt"]), N_CORE__HAS_RESULT_TYPE=_has(core["result_type"])
            ),
        ).otherwise(empty),
        _numbers(N_META__HAS_CURSOR_META=_flag(meta.isNotNull())),
        F.when(meta.isNotNull(), _numbers(N_META__HAS_BINOP_OP=_has(meta["op_spelling"]), N_META__IS_TYPE_REF=_flag(meta["is_type_ref"]))).otherwise(empty),
        F.when(meta["num_args"].isNotNull(), _numbers(N_META__CALL_N_ARGS=meta["num_args"])).otherwise(empty),
        _numbers(N_PARENT__CHAIN_LEN=F.size(parents), N_INC__INCLUDES=F.size(includes), N_MACRO__HAS_MACROS=_flag(has_macros)),
        F.when(has_macros, _numbers(N_MACRO__DEF=macro("macro_def"), N_MACRO__USE=macro("macro_use"), N_MACRO__PP_DIRECTIVE=macro("pp_directive"))).otherwise(empty),
        _numbers(
            N_USING__DIRECTIVES=_sizes(_list(alias["using_directives"])), N_USING__DECLS=_sizes(_list(alias["using_decls"])),
            N_TYPEDEF__TYPEDEFS=F.size(_typedefs(ctx)), N_NS__NAMESPACES=_sizes(_list(alias["namespaces"])),
        ),
        _prefixed("N_TYPEDEF__UNDER__", categories["typedefs"]),
        _prefixed("N_DECL__TYPE_KIND__", kinds),
        _prefixed("N_DECL__VAR_KIND__", decls["var_kind_counts"]),
        _prefixed("N_DECL__FUNC_KIND__", decls["func_kind_counts"]),
        _numbers(N_DECL__TYPES_TOTAL=_total(kinds), N_DECL__VARS_TOTAL=_total(decls["var_kind_counts"]), N_DECL__FUNCS_TOTAL=_total(decls["func_kind_counts"])),
        _prefixed("N_DECL__VARS_TYPE__", categories["variables"]),
        *(
            F.when(has_kind(k), F.create_map(F.lit(f"N_DECL__HAS_{name}"), F.lit(1.0))).otherwise(empty)
            for k, name in (("STRUCT_DECL", "STRUCT"), ("CLASS_DECL", "CLASS"), ("ENUM_DECL", "ENUM"), ("CLASS_TEMPLATE", "CLASS_TEMPLATE"))
        ),
    )


def _of_context(ctx: Column, use) -> Column:
    """``use`` of a context and its categories, which are worked out once a row; null without a context."""
    return once(ctx, lambda c: F.when(c.isNotNull() & (F.to_json(c) != "{}"), once(_categories(c), lambda k: use(c, k))))


def context_features(ctx: Column) -> tuple[Column, Column]:
    """(tokens array<string>, numeric map<string,double>) of a context; both null without one."""
    return _of_context(ctx, _tokens), _of_context(ctx, _numeric)


def context_columns(ctx: Column) -> tuple[Column, Column]:
    """Tokens and numbers as JSON texts, null without a context."""
    tokens, numeric = context_features(ctx)
    return F.to_json(tokens), F.to_json(numeric)


def with_context_columns(df: DataFrame, column: str = "ctx") -> DataFrame:
    """ctx_tokens and ctx_numeric, as by ``context_columns``, instead of the context, which is taken apart once for both."""
    both = _of_context(F.col(column), lambda c, k: F.struct(_tokens(c, k).alias("tokens"), _numeric(c, k).alias("numeric")))
    made = df.withColumn("_features", both).withColumns({"ctx_tokens": F.to_json("_features.tokens"), "ctx_numeric": F.to_json("_features.numeric")})
    return made.drop("_features", column)


def tokens_of(x: Column) -> Column:
    return F.from_json(x, "array<string>")


def numbers_of(x: Column) -> Column:
    return F.from_json(x, "map<string,double>")


def histogram(df: DataFrame, by: str, kind: str) -> DataFrame:
    """(by, map of kind to how many)."""
    counts = df.groupBy(by, kind).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(kind, "n"))).alias("counts"))
