"""Labeling functions: a recommendation code for a diagnostic, or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlint.functions import diagnostics as D
from emberlint.functions import predicates as P
from emberlint.functions import text as X
from emberlint.functions import types as Y
from emberlint.functions import values as V
from emberlint.functions.similarity import compared

CODE, TEXT, SOURCE, LINE = "error_code", "error_text", "source_code", "error_line"


def _window(radius: int) -> Column:
    return X.line_window(X.unescape_source(F.col(SOURCE)), F.col(LINE), radius)


def _chain(*rules: tuple[Column, str | None]) -> Column:
    """The label of the first rule that holds."""
    out = F.lit(None).cast("string")
    for test, label in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(label).cast("string")).otherwise(out)
    return out


def header_name(code: str) -> Column:
    """A name that a header declares, also behind marks of unknown letters."""
    ident = D.named_identifier(F.col(TEXT))
    known = ident.isin(*V.HEADER_NAMES) | F.regexp_replace(ident, r"^[?$]+", "").isin(*V.HEADER_NAMES)
    return _chain(((F.col(CODE) == code) & known, "HEADER_OR_STD_NAMESPACE"))


def _identifier_of(code: str | None) -> Column:
    """The named identifier; with ``code`` null for other codes, so that similarities are worked out for these rows alone."""
    ident = D.named_identifier(F.col(TEXT))
    return F.when(F.col(CODE) == code, ident) if code else ident


def _spelling_words(known: tuple[str, ...] | None = None) -> dict[str, tuple[tuple[str, ...], tuple[str, ...]]]:
    """The two lists that names of a code are compared with."""
    return {"C2065": (tuple(V.TYPE_WORDS), tuple(V.CONTROL_WORDS)), "C3861": (tuple(V.LOOP_WORDS), tuple(known or V.std_functions()))}


ODD = "[^A-Za-z0-9_]"


def _compared_name(ident: Column, known) -> Column:
    """A name that isn't known and has no odd letters: only such ones need similarities."""
    return F.when(~ident.rlike(ODD) & ~ident.isin(*known), ident)


def _variables_near(name: Column) -> Column:
    return F.when(name.isNotNull(), F.array_remove(X.identifier_candidates(F.col(SOURCE), F.col(LINE)), name))


def _functions_near(name: Column, known: tuple[str, ...]) -> Column:
    return F.when(name.isNotNull(), F.array_remove(X.call_candidates(F.col(SOURCE), F.col(LINE), known), name))


def _judged(ident: Column, found: Column, rules) -> Column:
    """A label by rules (name, line, closeness of the name), each of which is worked out once a row; null without a name."""
    line, both = F.array_join(_window(1), "\n"), F.struct(ident.alias("ident"), found.alias("found"))
    return F.when(ident.isNotNull(), X.once(both, lambda s: X.once(line, lambda of: rules(s["ident"], of, s["found"]))))


def _variable_rules(ident: Column, line: Column, found: Column) -> Column:
    label = "FIX_NAME_SPELLING"
    control_typo = P.keyword_typo(ident, found["second"], found["second_score"])
    type_like = P.type_like(line, ident)
    return _chain(
        (ident.rlike(ODD), label),
        (ident.isin(*V.HEADER_NAMES), None),
        (P.keyword_typo(ident, found["first"], found["first_score"]) & type_like, label),
        (type_like, None),
        (control_typo & P.control_like(line, ident), label),
        (control_typo, None),
        (found["near"], label),
    )


def _function_rules(known: tuple[str, ...]):
    def rules(ident: Column, line: Column, found: Column) -> Column:
        label = "FIX_NAME_SPELLING"
        loop_typo = P.keyword_typo(ident, found["first"], found["first_score"])
        return _chain(
            (ident.rlike(ODD), label),
            (ident.isin(*known), None),
            (loop_typo & P.loop_like(line, ident), label),
            (loop_typo, None),
            (P.keyword_typo(ident, found["second"], found["second_score"]), label),
            (found["near"], label),
        )

    return rules


def variable_spelling(only: str | None = None) -> Column:
    """A misspelt variable or type of a C2065; with ``only`` null for other codes."""
    ident = _identifier_of(only)
    name = _compared_name(ident, V.HEADER_NAMES)
    return _judged(ident, compared(name, _variables_near(name), F.lit("C2065"), _spelling_words()), _variable_rules)


def function_spelling(known: tuple[str, ...] | None = None, only: str | None = None) -> Column:
    """A misspelt function of a C3861; with ``only`` null for other codes."""
    ident, words = _identifier_of(only), _spelling_words(known)
    known = words["C3861"][1]
    name = _compared_name(ident, known)
    return _judged(ident, compared(name, _functions_near(name, known), F.lit("C3861"), words), _function_rules(known))


def _either_spelling(known: tuple[str, ...] | None) -> Column:
    """``variable_spelling`` of a C2065, ``function_spelling`` of a C3861, by one step of Python."""
    words = _spelling_words(known)
    known, code = words["C3861"][1], F.col(CODE)
    variable, function = _identifier_of("C2065"), _identifier_of("C3861")
    of_variable, of_function = _compared_name(variable, V.HEADER_NAMES), _compared_name(function, known)
    name = F.when(code == "C2065", of_variable).when(code == "C3861", of_function)
    others = F.when(code == "C2065", _variables_near(of_variable)).when(code == "C3861", _functions_near(of_function, known))
    found = compared(name, others, code, words)
    return F.when(code == "C2065", _judged(variable, found, _variable_rules)).when(code == "C3861", _judged(function, found, _function_rules(known)))


def wrong_construction() -> Column:
    """A construction of a C2146 that lacks an operator or separator."""
    ident = D.identifier_after_token(F.col(TEXT))

    def wrong(line: Column, ident: Column) -> Column:
        return (
            P.missing_shift(line)
            | P.for_without_semicolons(line)
            | P.missing_separator_in_call(line, ident)
            | P.missing_operator_in_condition(line, ident)
            | P.missing_comma_in_declaration(line, ident)
        )

    found = X.once(ident, lambda i: X.once(F.when(i.isNotNull(), X.focus_line(_window(1), i)), lambda line: i.isNotNull() & wrong(line, i)))
    return F.when(F.col(CODE) == "C2146", _chain((found, "INCORRECT_CONSTRUCTION_OR_SYMBOLS")))


def failing_cast() -> Column:
    """A C2440 at an explicit cast to its target."""
    _, target = D.conversion_types(F.col(TEXT))
    cast = F.exists(_window(1), lambda x: P.has_cast(x, Y.cast_pattern(target)))
    return _chain(((F.col(CODE) == "C2440") & target.isNotNull() & cast, "FIX_CAST"))


def pointer_comparison() -> Column:
    """A C2446 that compares pointers with something else or texts by address."""
    op = D.comparison_operator(F.col(TEXT))
    near = F.array_join(F.filter(_window(1), lambda x: x.contains(op)), "\n")
    types = F.filter(D.quoted_parts(F.col(TEXT)), P.type_spelling)
    pointers = F.filter(types, P.pointer_or_array)
    chars, label = F.exists(pointers, P.char_like), "FIX_POINTERS_FOR_CAST"
    text_compared = P.string_compared(near, op)
    return F.when(
        F.col(CODE) == "C2446",
        _chain(
            (~F.coalesce(op.isin(*V.COMPARISONS), F.lit(False)) | (near == ""), None),
            (P.is_kind(near, "content_comparison") | P.compared_with_null(near, op) | (F.size(pointers) == 0), None),
            (text_compared & (P.is_kind(near, "find_comparison") | (F.exists(types, P.char_array) & F.exists(types, P.arithmetic_type))), None),
            (op.isin("==", "!=") & (F.size(pointers) >= 2) & chars & P.has_string(near), label),
            (op.isin("==", "!=") & (F.size(pointers) == 1) & (F.size(types) >= 2) & (F.size(F.array_except(types, pointers)) > 0), label),
            ((F.size(pointers) >= 2) & chars, label),
        ),
    )


def best_type(quoted: Column, op: Column) -> Column:
    """The longest quoted fragment that looks like a type, the first of equal ones; empty without any."""
    like = lambda t: t.rlike(r"^(?:const\s+)?(?:[A-Za-z_]\w*::)*[A-Za-z_]\w*(?:\s*<.*>\s*)?(?:\s*[*&]\s*)*$") | t.contains("std") | t.contains("::") | t.contains("<") | t.contains(" ")
    found = F.filter(quoted, lambda t: (t != "") & ~t.isin(*V.OPERATORS) & ~F.coalesce(t == op, F.lit(False)) & like(t))
    ordered = F.array_sort(F.transform(found, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    return F.coalesce(F.get(ordered, F.lit(0))["t"], F.lit(""))


def operator_expression() -> Column:
    """A C2676 whose expression, not its operator, is wrong, by the type's kind and the operator."""
    op, quoted = D.operator_and_quoted(F.col(TEXT))
    label = "FIX_EXPR_FOR_OPERATOR"

    def by_kind(op: Column, kind: Column, outer: Column) -> Column:
        some = lambda k: P.is_kind(outer, k) | P.is_kind(kind, k) | P.is_kind(F.col(TEXT), k)
        stream = lambda k: P.is_kind(F.col(TEXT), k) | P.is_kind(kind, k)
        plain = (outer != "") & ~P.is_kind(outer, "container") & ~stream("ostream") & ~stream("istream")
        return _chain(
            (op.isNull(), None),
            (stream("ostream") & op.isin("<", ">", ">>", ">>=", "<<="), None),
            (stream("istream") & op.isin("<", ">", "<<", ">>=", "<<="), None),
            (some("iterator") & op.isin(*V.ORDERINGS, *V.ITERATOR_ARITHMETIC), label),
            (some("complex") & op.isin(*V.ARITHMETIC, "++", "--"), label),
            (P.is_kind(outer, "string") & op.isin("<<", ">>", "==", "!=", "<", ">", "<=", ">=", "+=", "-=", ">>=", "<<="), label),
            (P.is_kind(outer, "pair") & op.isin(*V.COMPARISONS), label),
            ((op == "[") & (some("not_indexable") | (some("container") & ~some("indexable"))), label),
            (op.isin(*V.ARITHMETIC) & some("container"), label),
            (plain & op.isin(*V.ARITHMETIC, *V.COMPARISONS, "++", "--", "&", "|", "^", "&&", "||"), label),
        )

    def by_parts(parts: Column) -> Column:
        first = F.get(parts["quoted"], F.lit(0))
        found = F.coalesce(parts["op"], F.when(first.isin(*V.OPERATORS), first))
        return X.once(found, lambda op: X.once(best_type(parts["quoted"], op), lambda kind: X.once(Y.outer_type(kind), lambda outer: by_kind(op, kind, outer))))

    return F.when(F.col(CODE) == "C2676", X.once(F.struct(op.alias("op"), quoted.alias("quoted")), by_parts))


def left_operand() -> Column:
    """A C2678 whose left operand is wrong."""
    op, kind = D.left_operand(F.col(TEXT))
    outer, qualifiers = Y.outer_and_qualifiers(kind)
    window = _window(2)
    focus = F.filter(window, lambda x: x.contains(op))
    near = F.array_join(F.when(F.size(focus) > 0, focus).otherwise(window), "\n")
    bare = X.blank_literals(near)
    rest = lambda t: F.when(F.instr(t, op) > 0, F.substr(t, F.instr(t, op) + F.length(op))).otherwise("")
    out, into = P.is_kind(outer, "ostream"), P.is_kind(outer, "istream")
    some = lambda k: P.is_kind(outer, k) | P.is_kind(kind, k) | P.is_kind(F.col(TEXT), k)
    read_before = P.shift_before(near, op, P.CIN_SHIFT, P.EXTRACTED)
    label = "FIX_LEFT_OPERAND"
    return F.when(
        F.col(CODE) == "C2678",
        _chain(
            (op.isNull() | kind.isNull(), None),
            ((out & op.isin("<", ">", ">>")) | (into & op.isin("<", ">", "<<")), None),
            (F.array_contains(qualifiers, "const") & op.isin(*V.MUTATING), label),
            (some("complex") & op.isin(*V.ORDERINGS), label),
            (some("string") & op.isin("&&", "||") & ~P.is_kind(F.regexp_replace(bare, "<<|>>", " "), "boolish"), label),
            (out & op.isin(*V.STREAM_PRECEDENCE) & P.shift_before(near, op, P.COUT_SHIFT, P.INSERTED), label),
            (into & op.isin("==", "!=") & (P.is_kind(bare, "eof") | P.is_kind(near, "eof_text") | P.is_kind(rest(bare), "constant")) & read_before, label),
            (into & op.isin("&&", "||") & read_before, label),
            (into & op.isin("&", "|") & read_before & P.is_kind(rest(near), "bool_operand"), label),
        ),
    )


def right_operand() -> Column:
    """A C2679 whose right operand is wrong."""
    op, kind = D.right_operand(F.col(TEXT))
    window = _window(2)
    focus = X.focus_lines(window, op)
    near = F.array_join(F.when(F.size(focus) > 0, focus).otherwise(window), "\n")
    of = lambda k: P.is_kind(kind, k)
    either = of("container") | P.is_kind(F.col(TEXT), "container")
    plain = ~P.char_like(kind)
    wrong = (
        of("void")
        | (op.isin("<<", ">>") & of("overloaded"))
        | ((op == ">>") & (of("const_char_array") | of("const") | (P.array_type(kind) & plain) | (kind.contains("*") & plain) | either))
        | ((op == "<<") & (of("iterator") | of("pair") | either))
        | ((op == "[") & P.is_kind(near, "long_char_index"))
        | ((op == "=") & of("container"))
        | (op.isin(*V.ARITHMETIC) & ((P.pointer_or_array(kind) & plain) | of("iterator") | of("pair")))
    )
    return _chain(((F.col(CODE) == "C2679") & op.isNotNull() & kind.isNotNull() & wrong, "FIX_RIGHT_OPERAND"))


#: Those in use, in the order in which later ones win. The others stand ready.
REGISTRY = ("spelling_C2065", "header_C2065", "spelling_C3861", "header_C3861", "construction_C2146", "expression_C2676")


def default_label(code: Column) -> Column:
    """The first recommendation of a code."""
    out = F.lit(None).cast("string")
    for c, r in reversed(V.RECOMMENDATIONS):
        out = F.when(code == c, r).otherwise(out)
    return out


def combined(suggestions: list[Column], default: Column) -> Column:
    """The last suggestion there is, else the default."""
    return F.coalesce(*reversed(suggestions), default)


def apply_labels(df: DataFrame, known_functions: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` with label_code: suggestions of the functions in use, else label_code as it is, else the code's default.

    One pass over ``df``; Python, for similarities, gets the names of the two codes that need it and nulls for others.
    """
    was = F.col("label_code") if "label_code" in df.columns else default_label(F.col(CODE))
    suggestions = [_either_spelling(known_functions), header_name("C2065"), header_name("C3861"), wrong_construction(), operator_expression()]
    return df.withColumn("label_code", combined(suggestions, was))
