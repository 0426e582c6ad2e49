"""Names found by bounds are those that comparing all of them finds."""

import random
from difflib import SequenceMatcher

from hypothesis import given
from hypothesis import strategies as st

from emberlint.functions import similarity as S
from emberlint.functions import values as V

NAMES = st.text("abcAB_", max_size=8)


def plain(name, others, bonus, least):
    scored = []
    for o in others:
        if o and name:
            score = SequenceMatcher(None, name, o).ratio() + (S._bonus(name, o) if bonus else 0.0)
            scored.append((-score, o))
    if not scored or -min(scored)[0] < least or min(scored)[0] == 0:
        return None, 0.0
    return min(scored)[1], -min(scored)[0]


@given(NAMES, st.lists(NAMES, max_size=12), st.booleans(), st.sampled_from([0.0, 0.5, 0.8]))
def test_best_by_bounds(name, others, bonus, least):
    assert S._best(name, others, bonus, least) == plain(name, others, bonus, least)


@given(NAMES.filter(bool), st.lists(NAMES, max_size=12))
def test_near_is_a_best_match(name, others):
    assert any(S._reaches(name, o, 0.8) for o in others if o) == (plain(name, others, True, 0.8)[0] is not None)


@given(NAMES, NAMES)
def test_no_ratio_passes_its_bound(a, b):
    assert SequenceMatcher(None, a, b).ratio() <= S.bound(a, b)


def test_few_pairs_are_compared(monkeypatch):
    """Of misspelt standard names, a small share of all pairs needs a comparison."""
    import difflib

    compared = []

    class Counting(SequenceMatcher):
        def __init__(self, *args):
            compared.append(args)
            super().__init__(*args)

    rng = random.Random(1)
    names = []
    for w in V.STD_FUNCTIONS:
        k = rng.randrange(len(w))
        names.append(w[:k] + rng.choice("abcdefgh") + w[k + 1 :])
    want = [plain(n, V.STD_FUNCTIONS, True, 0.8) for n in names]
    monkeypatch.setattr(difflib, "SequenceMatcher", Counting)
    assert [S._best(n, V.STD_FUNCTIONS, True, 0.8) for n in names] == want
    assert len(compared) < 0.05 * len(names) * len(V.STD_FUNCTIONS)
