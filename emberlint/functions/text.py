"""Program texts and lines: comments, literals, includes, windows, candidates. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlint.functions import values as V

C = F.col
# Literals, includes, names and the headers that the catch-all one stands for.
#: A string or character literal, a line comment, a block comment (to the end if it is never closed).
COMMENTS = r"""(?s)("(?:\\.|[^"\\])*(?:"|$)|'(?:\\.|[^'\\])*(?:'|$))|//[^\n]*|/\*.*?(?:\*/|$)"""
RAW_LITERAL = r'(?s)(?:u8|u|U|L)?R"(?<d>[^()\s\\]{0,16})\(.*?\)\k<d>"'
STRING_LITERAL = r'(?s)(?:u8|u|U|L)?"(?:\\.|[^"\\])*"'
CHAR_LITERAL = r"(?s)(?:u8|u|U|L)?'(?:\\.|[^'\\])+'"
BITS_HEADER = r'#\s*include\s*(?:<\s*bits/stdc\+\+\.h\s*>|"\s*bits/stdc\+\+\.h\s*")'
#: What the catch-all header stands for.
STANDARD_INCLUDES = ("iostream", "iomanip", "vector", "string", "map", "set", "queue", "stack", "algorithm", "cmath", "cstdio", "cstring", "cstdlib")
IDENTIFIER = r"\b[A-Za-z_][A-Za-z0-9_]*\b"
CALL = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("


def once(x: Column, use) -> Column:
    """``use`` of ``x``, which is worked out once a row however often ``use`` names it; within branches and lambdas the optimizer repeats it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def strip_comments(code: Column) -> Column:
    return strip(F.regexp_replace(strip(code), COMMENTS, "$1"))


def blank_literals(x: Column) -> Column:
    """Raw strings, strings and characters emptied; null is empty."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), RAW_LITERAL, '""')
    return F.regexp_replace(F.regexp_replace(x, STRING_LITERAL, '""'), CHAR_LITERAL, "''")


def replace_bits_header(code: Column, headers: tuple[str, ...] = STANDARD_INCLUDES) -> Column:
    return F.regexp_replace(code, BITS_HEADER, "\n".join(f"#include <{h}>" for h in headers))


def unescape_source(code: Column) -> Column:
    """Escaped line feeds become line feeds; null is empty."""
    return F.replace(F.coalesce(code, F.lit("")), F.lit("\\n"), F.lit("\n"))


_HIGH = bytes(range(128, 256))


def decode_output(raw: Column) -> Column:
    """Compiler output in bytes: UTF-8, else code page 866."""
    by_byte = F.translate(F.decode(raw, "ISO-8859-1"), _HIGH.decode("latin-1"), _HIGH.decode("cp866"))
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(by_byte)


def valid_utf8(x: Column) -> Column:
    return F.make_valid_utf8(x.cast("string"))


def first_error(output: Column) -> tuple[Column, Column]:
    """(text after the first "error " to the end of its line, line of the first ".cpp(n)" anywhere); without an error the whole text and no line."""
    found = F.instr(output, "error ") > 0
    said = F.when(found, strip(F.regexp_extract(output, r"(?sd)error ([^\n]*)", 1))).otherwise(strip(output))
    line = F.when(found, F.nullif(F.regexp_extract(output, r"\.cpp\((\d+)\)", 1), F.lit("")).cast("int"))
    return said, line


def lines(code: Column) -> Column:
    return F.split(code, "\n")


def _around(of: Column, line: Column, radius: int) -> Column:
    i = F.greatest(line - 1, F.lit(0))
    start = F.greatest(i - radius, F.lit(0))
    many = F.least(F.size(of), i + radius + 1) - start
    return F.when(many > 0, F.slice(of, start + 1, F.greatest(many, F.lit(0)))).otherwise(F.array().cast("array<string>"))


def line_window(code: Column, line: Column, radius: int = 1) -> Column:
    """Lines around a line counted from 1, clipped at the ends of the text."""
    return once(lines(code), lambda of: _around(of, line, radius))


def wide_window(code: Column, line: Column, radius: int = 10) -> Column:
    """As ``line_window``, but all lines where the line is missing or isn't in the text."""
    outside = lambda of: line.isNull() | (line <= 0) | (line > F.size(of))
    return once(lines(code), lambda of: F.when(outside(of), of).otherwise(_around(of, F.coalesce(line, F.lit(1)), radius)))


def number_lines(code: Column) -> Column:
    """Each line behind its number, right-aligned."""
    width = F.length(F.size(lines(code)).cast("string"))
    said = F.transform(lines(code), lambda x, i: F.concat(F.lpad((i + 1).cast("string"), width, F.lit(" ")), F.lit(" | "), x))
    return F.array_join(said, "\n")


def quote(x: Column) -> Column:
    """A pattern that matches just this text."""
    return F.regexp_replace(x, r"([\\.\[\]{}()*+?^$|\-&#~ ])", r"\\$1")


def has_word(x: Column, word: Column) -> Column:
    return F.rlike(x, F.concat(F.lit(r"\b"), quote(word), F.lit(r"\b")))


def focus_line(window: Column, ident: Column) -> Column:
    """The first line with the identifier as a word, else the middle one; empty without lines."""
    named = F.try_element_at(F.filter(window, lambda x: has_word(x, ident)), F.lit(1))
    middle = F.get(window, F.floor(F.size(window) / 2).cast("int"))
    return F.coalesce(F.when(F.coalesce(ident, F.lit("")) != "", named), middle, F.lit(""))


#: Operators that others contain are found only alone.
OPERATOR_PATTERNS = {"=": r"(?<![=!<>])=(?!=)", "<<": r"(?<!<)<<(?![=<])", ">>": r"(?<!>)>>(?![=>])", "[": r"\["}


def focus_lines(window: Column, op: Column) -> Column:
    """Lines that have the operator outside of literals."""
    pattern = quote(op)
    for k, p in OPERATOR_PATTERNS.items():
        pattern = F.when(op == k, F.lit(p)).otherwise(pattern)
    return F.filter(window, lambda x: F.rlike(blank_literals(x), pattern))


def identifier_candidates(code: Column, line: Column, radius: int = 10) -> Column:
    """Distinct identifiers around a line that aren't keywords, in order of appearance."""
    near = F.array_join(wide_window(unescape_source(code), line, radius), "\n")
    return _distinct_but(F.regexp_extract_all(near, F.lit(IDENTIFIER), F.lit(0)), V.KEYWORDS)


def call_candidates(code: Column, line: Column, known: tuple[str, ...], radius: int = 10) -> Column:
    """Distinct names of called functions around a line, standard ones left out."""
    near = F.array_join(wide_window(unescape_source(code), line, radius), "\n")
    return _distinct_but(F.regexp_extract_all(near, F.lit(CALL), F.lit(1)), known)


def _distinct_but(found: Column, known) -> Column:
    """Distinct texts that aren't known; what is known becomes one set for all rows, which ``array_except`` would make anew for each."""
    return F.filter(F.array_distinct(found), lambda w: ~w.isin(*known)) if known else F.array_distinct(found)


def has_macros(code: Column) -> Column:
    return F.coalesce(code.rlike(r"#\s*(?:define|undef|if|ifdef|ifndef|elif|pragma)"), F.lit(False))


def format_cell(x: Column, width: int = 80) -> Column:
    """Line feeds shown as \\n; longer texts cut with three dots."""
    x = F.replace(x, F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(x) > width, F.concat(F.substring(x, 1, width - 3), F.lit("..."))).otherwise(x)


def fill_template(pattern: Column, choices: dict[str, Column]) -> Column:
    """Every <NAME> of ``choices`` replaced by its value."""
    for name, value in choices.items():
        pattern = F.replace(pattern, F.lit(f"<{name}>"), value)
    return pattern


def code_hash(code: Column) -> Column:
    return F.sha2(code, 256)


def token_class(token: Column) -> Column:
    """Lexical class of a token of a program: number, text, operator, keyword or identifier; other tokens stand for themselves."""
    number = token.rlike(r"^[+-]*(?:\d+\.?\d*|\.\d+)$")
    literal = token.rlike(r"""^(?:(?:u8|u|U|L)?R?["']|[+-]*\.?\d)""")
    named = token.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")
    return (
        F.when(number, "<NUM>").when(literal, "<STR>").when(token.isin(*V.TOKEN_OPERATORS), F.concat(F.lit("OP_"), token))
        .when(token.isin(*V.KEYWORDS), "KEYWORD").when(named, "<ID_IDENT>").otherwise(token)
    )


#: Directives that have a class of their own; others are <PP_OTHER>.
DIRECTIVES = {"include": "INCLUDE", "define": "DEFINE", "pragma": "PRAGMA", "if": "IF", "ifdef": "IF", "ifndef": "IF", "elif": "ELIF", "else": "ELSE", "endif": "ENDIF"}


def directive_class(line: Column) -> Column:
    """Class of a preprocessor line, null for other lines."""
    name = F.regexp_extract(line, r"^\s*#\s*([A-Za-z_]\w*)", 1)
    out = F.lit("<PP_OTHER>")
    for word, kind in DIRECTIVES.items():
        out = F.when(name == word, f"<PP_{kind}>").otherwise(out)
    return F.when(name != "", out)


def operator_spelling(tokens: Column) -> Column:
    """The first of an expression's tokens that is an operator, null without one."""
    return F.try_element_at(F.filter(tokens, lambda t: t.isin(*V.TOKEN_OPERATORS)), F.lit(1))


def shift_operands(x: Column, op: str) -> Column:
    """Names right of a shift operator."""
    return F.regexp_extract_all(blank_literals(x), F.lit(rf"(?i){op}\s*(?:std::)?([A-Za-z_]\w*)"), F.lit(1)) if op in ("<<", ">>") else F.array().cast("array<string>")


def assigned_name(x: Column) -> Column:
    """The name left of the first assignment."""
    return F.regexp_extract(blank_literals(x), r"\b([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*=", 1)
