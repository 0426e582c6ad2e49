"""Texts of diagnostics: placeholders, tokens, and what they name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlint.functions.text import strip

NAMED = r": ([^:]+):"
QUOTED = '"[^"]+"'
#: Words for kinds of literals, quoted or not.
_WORDS = ("user-defined string literal", "user-defined literal", "константа", "строка")
LITERAL_WORDS = "|".join([*(f'"{w}"' for w in _WORDS), *_WORDS])
TOKEN = "<[A-Z0-9_]+>|C\\d{4}|[A-Za-zА-Яа-яЁё0-9_]+"


def first_replaced(x: Column, pattern: str, by: str) -> Column:
    """The first match of ``pattern`` replaced."""
    return F.regexp_replace(x, f"(?s)^(.*?)(?:{pattern})", "$1" + by)


def normalize_error(x: Column) -> Column:
    """What a diagnostic names, replaced by placeholders, by its code; other codes give an empty text."""
    two = lambda s, a, b: first_replaced(first_replaced(s, QUOTED, a), QUOTED, b)
    literals = F.regexp_replace(x, LITERAL_WORDS, "<LITER>")
    rewrites = {
        ("C2065",): first_replaced(x, NAMED, ": <IDENT>:"),
        ("C3861", "C2672"): first_replaced(x, NAMED, ": <FUNC>:"),
        ("C2039",): two(x, "<IDENT>", "<DECL>"),
        ("C2143",): two(literals, "<TOKEN>", "<IDENT>"),
        ("C2146",): two(x, "<TOKEN>", "<IDENT>"),
        ("C2059",): F.regexp_replace(literals, r"(?U)(?<=: )\w+$", "<IDENT>"),
        ("C2144",): two(x, "<TYPE>", "<TOKEN>"),
        ("C2187",): first_replaced(x, QUOTED, "<IDENT>"),
        ("C1075",): first_replaced(x, r'"\{"', "<BRACE>"),
        ("C2131", "C2148", "C2181"): x,
        ("C2440",): two(first_replaced(x, NAMED, ": <CONTEXT>"), "<TYPE_1>", "<TYPE_2>"),
        ("C2446",): two(F.regexp_replace(x, r"^([^:\n]*:\s*)(\S+?)(?=\s|:)", "$1<OPER>"), "<TYPE_1>", "<TYPE_2>"),
        ("C2676", "C2678", "C2679"): two(x, "<OPER>", "<TYPE>"),
        ("C2064",): first_replaced(x, r"принимающая \d+", "принимающая <NUM>"),
        ("C1083",): F.regexp_replace(x, r"^((?:[^:]*:){2}).*$", "$1 <PATH>"),
        ("C2106",): first_replaced(x, r": \S+:", ": <OPER>:"),
    }
    code, out = F.substring(x, 1, 5), F.lit("")
    for codes, rewrite in rewrites.items():
        out = F.when(code.isin(*codes), rewrite).otherwise(out)
    return out


def error_tokens(x: Column) -> Column:
    """Placeholders, codes and words of the normalised text; none for null."""
    return F.coalesce(F.regexp_extract_all(normalize_error(x), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def _part(x: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(strip(F.regexp_extract(x, pattern, group)), F.lit(""))


def named_identifier(x: Column) -> Column:
    return _part(x, r"^C\d{4}: ([^:]+):")


def identifier_after_token(x: Column) -> Column:
    """The identifier before which something is missing."""
    return _part(x, """(?iu)перед\\s+идентификатором\\s*['"“”]([^'"“”]+)['"“”]""")


# Wording of the diagnostics.
_CONVERSION = """(?iu)C2440:.*?невозможно\\s+преобразовать\\s*["']([^"']+)["']\\s*(?:в|to)\\s*["']([^"']+)["']"""
_OPERAND = """(?iu)^\\s*%s:\\s*(?:бинарн[\\wа-яё]*|унарн[\\wа-яё]*)?\\s*["']([^"']+)["']\\s*:\\s*.*?операнд[\\wа-яё]*\\s+типа\\s*["']([^"']+)["']"""


def conversion_types(x: Column) -> tuple[Column, Column]:
    """(from, to) of a failed conversion."""
    return _part(x, _CONVERSION, 1), _part(x, _CONVERSION, 2)


def comparison_operator(x: Column) -> Column:
    return _part(strip(x), r"^C2446:\s*(:|==|!=|<=|>=|<|>)\s*:?")


def quoted_parts(x: Column) -> Column:
    """All quoted fragments, without their quotes and outer white space."""
    found = F.regexp_extract_all(x, F.lit("""(?s)"[^"\\n]*"|'[^'\\n]*'"""), F.lit(0))
    return F.coalesce(F.transform(found, lambda s: strip(F.substring(s, F.lit(2), F.length(s) - 2))), F.array().cast("array<string>"))


def operator_and_quoted(x: Column) -> tuple[Column, Column]:
    """(operator of a C2676, all quoted fragments)."""
    return _part(x, """(?iu)^\\s*C2676:\\s*(?:бинарн[\\wа-яё]*|унарн[\\wа-яё]*)?\\s*["']([^"']+)["']\\s*:\\s*"""), quoted_parts(x)


def left_operand(x: Column) -> tuple[Column, Column]:
    """(operator, left type) of a C2678."""
    return _part(strip(x), _OPERAND.replace("%s", "C2678"), 1), _part(strip(x), _OPERAND.replace("%s", "C2678"), 2)


def right_operand(x: Column) -> tuple[Column, Column]:
    """(operator, right type) of a C2679."""
    return _part(strip(x), _OPERAND.replace("%s", "C2679"), 1), _part(strip(x), _OPERAND.replace("%s", "C2679"), 2)


def has_error_code(x: Column, code: str) -> Column:
    """The code stands in the text as a word; never for null."""
    return F.coalesce(x.rlike(rf"\b{code}\b"), F.lit(False))
