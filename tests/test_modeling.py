"""Features of rows and a trained classifier, against plain Python."""

import json
from collections import Counter

from emberlint.plans import modeling

SCHEMA = "row_id long, label int, error_text_tokens string, ctx_tokens string, ctx_numeric string"


def _runs(block, tokens):
    least, most = modeling.NGRAMS[block]
    return Counter(f"{block}:{' '.join(tokens[i : i + n])}" for n in range(least, most + 1) for i in range(len(tokens) - n + 1))


def test_entries(spark):
    """Runs are counted by row and block; rows move once, by their key, before they are taken apart."""
    said = [(["a", "b", "a", "b"], ["a", "a"], {"n": 2.5, "m": -1.0}), ([], ["x"], {}), (None, None, None), (["a"], [], {"n": 0.0})]
    rows = [(k, 0, *(None if x is None else json.dumps(x) for x in s)) for k, s in enumerate(said)] + [(9, 0, "no list", "{", "[]")]
    found = modeling.entries(spark.createDataFrame(rows, SCHEMA))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    want = {(k, t): float(n) for k, (e, c, m) in enumerate(said) for t, n in (_runs("error", e or []) + _runs("ctx", c or [])).items()}
    want |= {(k, f"num:{t}"): v for k, (_, _, m) in enumerate(said) for t, v in (m or {}).items()}
    got = found.collect()
    assert len(got) == len(want) and {(r.row_id, r.term): r.value for r in got} == want
