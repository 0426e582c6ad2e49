"""Similarity of names: twice the matching characters over all characters, by longest common blocks."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that a worker remembers for each list of words, and pairs of names that it remembers.
MOST_NAMES = 100_000
MOST_PAIRS = 1_000_000
_COMPARED = T.StructType(
    [T.StructField(n, k) for n, k in (("first", T.StringType()), ("first_score", T.DoubleType()), ("second", T.StringType()), ("second_score", T.DoubleType()), ("near", T.BooleanType()))]
)
_SCORED = T.StructType([T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())])


def bound(a: str, b: str) -> float:
    """What the ratio of two names can't pass: blocks match at most the letters that both have, as often as both have them."""
    return 2.0 * sum(min(a.count(c), b.count(c)) for c in set(a)) / (len(a) + len(b)) if a or b else 1.0


def _bonus(name: str, o: str) -> float:
    return 0.05 * (o[0].lower() == name[0].lower()) + 0.05 * (abs(len(o) - len(name)) <= 1)


def _best(name: str | None, others, bonus: bool, least: float = 0.0) -> tuple[str | None, float]:
    """The most similar of ``others`` and its score, of equal ones the first in order; (None, 0.0) if none is above 0 and at least ``least``.

    Names go by their bounds, largest first, and the search ends at the first that can't reach the best score so far.
    """
    from difflib import SequenceMatcher

    best, most = None, 0.0
    extra = (lambda o: _bonus(name, o)) if bonus else (lambda o: 0.0)
    ordered = sorted((-(bound(name, o) + extra(o)), o) for o in set(others) if o) if name and others is not None else ()
    for reach, o in ordered:
        if -reach < max(most, least):
            break
        score = SequenceMatcher(None, name, o).ratio() + extra(o)
        if score > most or (score == most and best is not None and o < best):
            best, most = o, score
    return (best, most) if most >= least else (None, 0.0)


@lru_cache(maxsize=64)
def _remembered(words: tuple[tuple[str, ...], ...]) -> dict:
    """Names to what is closest in lists of words, kept by a worker from batch to batch."""
    return {}


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@lru_cache(maxsize=16)
def _matching(least: float):
    def find(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        seen: dict = {}
        rows = []
        for x, y in zip(a, b, strict=True):
            key = x, None if y is None else tuple(y)
            if key not in seen:
                seen[key] = _best(x, y, True, least)
            rows.append(seen[key])
        return pd.DataFrame(rows, columns=["name", "score"])

    find.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(find, _SCORED)


@lru_cache(maxsize=MOST_PAIRS)
def _reaches(name: str, o: str, least: float) -> bool:
    """Whether two names are as similar as ``least``, a common first letter and a like length counting a little."""
    from difflib import SequenceMatcher

    extra = _bonus(name, o)
    return 2.0 * min(len(name), len(o)) / (len(name) + len(o)) + extra >= least and bound(name, o) + extra >= least and SequenceMatcher(None, name, o).ratio() + extra >= least


def _facts(name: str, words: tuple[tuple[str, ...], tuple[str, ...]]) -> tuple:
    """The closest word of each list and its score. A worker compares each name once with each pair of lists, as far as it remembers."""
    seen = _remembered(words)
    if name not in seen:
        if len(seen) >= MOST_NAMES:
            seen.clear()
        seen[name] = _best(name, words[0], False) + _best(name, words[1], False)
    return seen[name]


def compared(name: Column, candidates: Column, which: Column, words: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], cutoff: float = 0.8) -> Column:
    """(first, first_score, second, second_score, near): of the two lists that ``which`` names the closest words, of equal ones the
    first in order, and whether any candidate is as similar as ``cutoff``. Without a name, nothing is close.

    One step of Python answers all of it, and rows without a name cost it next to nothing.
    """

    def find(a: pd.Series, b: pd.Series, of: pd.Series) -> pd.DataFrame:
        rows = [(None, 0.0, None, 0.0, False)] * len(a)
        named = [k for k, x in enumerate(a) if x]
        for k, x, others, w in zip(named, a.iloc[named], b.iloc[named], of.iloc[named], strict=True):
            near = others is not None and any(_reaches(x, o, cutoff) for o in others if o)
            rows[k] = (*_facts(x, words[w]), near)
        return pd.DataFrame(rows, columns=_COMPARED.names)

    find.__annotations__ = {"a": pd.Series, "b": pd.Series, "of": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(find, _COMPARED)(name, candidates, which)


def best_match(name: Column, candidates: Column, cutoff: float = 0.8) -> Column:
    """The most similar candidate, a common first letter and a like length counting a little; null below ``cutoff``."""
    return _matching(cutoff)(name, candidates)["name"]
