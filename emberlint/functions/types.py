"""Spellings of C++ types and of headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlint.functions import values as V
from emberlint.functions.text import once, strip


def clean_type(x: Column) -> Column:
    """Without qualifiers and a leading tag word, white space squeezed; null is empty."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"\b(const|volatile|restrict)\b", " ")
    x = F.regexp_replace(x, r"^\s*(struct|class|enum|union)\s+", "")
    return strip(F.regexp_replace(x, r"\s+", " "))


def type_category(x: Column) -> Column:
    """One of 14 categories; the order of the rules counts."""
    word = lambda s, known: s.rlike(f"(^| )({'|'.join(w for w in known if ' ' not in w)})( |$)")

    def category(s: Column, low: Column) -> Column:
        return (
            F.when(s.endswith("&"), "T_REF")
            .when(s.contains("*"), "T_PTR")
            .when(s.contains("[") & s.contains("]"), "T_ARRAY")
            .when(s.contains("(") & s.contains(")"), "T_FUNC")
            .when(s.contains("<") & s.contains(">"), "T_TEMPLATE")
            .when(s.startswith("std::"), "T_STD")
            .when(s.contains("::"), "T_NAMESPACE")
            .when(low == "void", "T_VOID")
            .when(low == "bool", "T_BOOL")
            .when(low.isin(*V.CHAR_WORDS), "T_CHAR")
            .when(low.isin(*V.FLOAT_WORDS) | word(low, V.FLOAT_WORDS), "T_FLOAT")
            .when(word(low, V.INT_WORDS), "T_INT")
            .otherwise("T_USER")
        )

    return F.when(x.isNull() | (x == ""), "T_UNKNOWN").otherwise(once(clean_type(x), lambda s: category(s, F.lower(s))))


def header_category(x: Column) -> Column:
    """Category of a header by its base name, null if unknown."""
    base = F.substring_index(F.substring_index(F.substring_index(F.coalesce(x, F.lit("")), "/", -1), "\\", -1), ".", 1)
    out = F.lit(None).cast("string")
    for name, headers in reversed(V.HEADERS.items()):
        out = F.when(base.isin(*headers), name).otherwise(out)
    return out


def normalize_type(x: Column) -> Column:
    """Without a leading tag word, white space squeezed."""
    return strip(F.regexp_replace(F.regexp_replace(strip(x), r"^(class|struct|enum)\s+", ""), r"\s+", " "))


def outer_type(x: Column) -> Column:
    """The qualified name that a type begins with, after const; empty if there is none."""
    return F.regexp_extract(F.coalesce(x, F.lit("")), r"^\s*(?:const\s+)?((?:[A-Za-z_]\w*::)*[A-Za-z_]\w*)", 1)


def outer_and_qualifiers(x: Column) -> tuple[Column, Column]:
    """(outer name, distinct qualifiers in lower case)."""
    pattern = r"(?i)^\s*((?:(?:const|volatile)\s+)*)(?:class|struct|enum)?\s*((?:[A-Za-z_]\w*::)*[A-Za-z_]\w*)"
    x = F.coalesce(x, F.lit(""))
    found = F.regexp_extract_all(F.lower(F.regexp_extract(x, pattern, 1)), F.lit(r"\b(const|volatile)\b"), F.lit(1))
    return F.regexp_extract(x, pattern, 2), F.array_distinct(found)


def cast_pattern(x: Column) -> Column:
    """A pattern for a type as the target of a cast: spellings of long integers, pointers and references after any spaces.

    Spaces within a type match any white space.
    """
    t = normalize_type(x)
    base = strip(F.regexp_replace(t, r"(?:\s*[*&]\s*)+$", ""))
    marks = F.regexp_extract_all(F.regexp_extract(t, r"((?:\s*[*&]\s*)+)$", 1), F.lit(r"[*&]"), F.lit(0))
    quoted = F.regexp_replace(F.regexp_replace(base, r"([\\.\[\]{}()*+?^$|&])", r"\\$1"), " ", r"\\s+")
    spelt = {
        "ll": r"ll|long\s+long|long\s+long\s+int|signed\s+long\s+long|signed\s+long\s+long\s+int",
        "ull": r"ull|unsigned\s+long\s+long|unsigned\s+long\s+long\s+int",
        "long long": r"long\s+long|long\s+long\s+int",
    }
    for name, said in spelt.items():
        quoted = F.when(base == name, F.lit(said)).otherwise(quoted)
    return F.concat(F.lit("(?:"), quoted, F.lit(")"), F.array_join(F.transform(marks, lambda m: F.concat(F.lit(r"\s*\\"[:-1]), m, F.lit(r"\s*"))), ""))
