import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberlint.llm import packing as P
from emberlint.llm import tokens as K
from emberlint.llm.common import scratch


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(K.default_tokenizer())
    t.encode_special_tokens = True
    return t


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab' \n\tsİΣςé.,!0½<|>endoftext|")), max_size=40))
def test_encoding_is_the_librarys(text):
    t = K._ids(K.default_tokenizer()).tokenizer
    assert np.frombuffer(K.encode(text, K.default_tokenizer()), "<u4").tolist() == ids(t, text)


def _crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_token_files(spark, frame, corpus, tokenizer):
    path = scratch(spark, "t")
    files = K.write_token_files(frame, path)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in K.token_digest(files).collect()}
    at, want = 0, {}
    for i, t in sorted(corpus):
        x = [*ids(tokenizer, t), K.END_ID]
        want[i] = (at, len(x), _crc(x))
        at += len(x)
    assert got == want
    # Reads of single columns don't touch the ids.
    assert "token_ids" not in files.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert files.where("doc_id = 3").first().token_ids == [*ids(tokenizer, corpus[3][1]), K.END_ID]


def test_token_files_of_awkward_rows(spark, awkward, empty, tokenizer):
    files = K.token_digest(K.write_token_files(awkward, scratch(spark, "t")))
    rows = sorted(((r.start, r.doc_id, r.n_tokens) for r in files.collect()))
    assert rows[0][1] is None and len(rows) == awkward.count()
    assert [r[0] for r in rows] == [sum(x[2] for x in rows[:k]) for k in range(len(rows))]
    assert K.token_digest(K.write_token_files(empty, scratch(spark, "t"))).count() == 0


def check_packing(rows, want, capacity):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, x in want.items():
        assert sorted(pieces[doc]) == [(k, s, len(x[s : s + capacity]), _crc(x[s : s + capacity])) for k, s in enumerate(range(0, len(x), capacity))]
    return len(sequences)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packed_documents(frame, corpus, tokenizer, capacity):
    want = {i: [*ids(tokenizer, t), P.END_ID] for i, t in corpus}
    n = check_packing(P.pack_documents(frame, capacity).collect(), want, capacity)
    assert n <= 1.03 * -(-sum(map(len, want.values())) // capacity) + 1


def test_packing_of_awkward_rows(awkward, empty):
    rows = P.pack_documents(awkward).collect()
    assert {r.doc_id for r in rows} == {None, 900, 901, 902, 903, 904, 905, 906}
    assert sorted(r.length for r in rows if r.doc_id in (900, 901, 902)) == [1, 1, 1]
    assert P.pack_documents(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40), st.integers(30, 40))
def test_plans_place_everything(lengths, capacity):
    counts = Counter(lengths)
    plan = P.plan_packing(dict(counts), capacity)
    used = defaultdict(list)
    for s, rows in plan.items():
        assert rows[0, 0] == 0 and rows[-1, 1] == counts[s]
        for lo, hi, first, each, offset in rows.tolist():
            for r in range(hi - lo):
                used[first + r // each].append((offset + r % each * s, s))
    for placed in used.values():
        at = 0
        for offset, s in sorted(placed):
            assert offset == at
            at += s
        assert at <= capacity
    assert sum(len(x) for x in used.values()) == len(lengths)


def _best(lengths, capacity):
    """Least number of sequences, by exhaustion."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[k]}.values():
            place(k + 1, rooms[:j] + [rooms[j] - lengths[k]] + rooms[j + 1 :])
        place(k + 1, [*rooms, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(2, 12), min_size=1, max_size=9))
def test_reduction_keeps_the_optimum(lengths):
    counts = dict(Counter(lengths))
    fixed = P.dominance_reduction(counts, 13)
    rest = [s for s, n in counts.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + (_best(rest, 13) if rest else 0) == _best(lengths, 13)
