import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """Invented documents with copies, near copies, shared passages, junk and personal data."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abdeilmnorstu", k=rng.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, passage = [], text(60)
    for _ in range(60):
        docs.append(text(rng.choice([0, 1, 3, 8, 30, 120, 400])))
    docs += [docs[40], docs[41] + " ", f"{text(30)} {passage} {text(10)}", f"{passage} {text(50)}", f"{text(5)}\n{passage}"]
    for k in (30, 31, 32, 33):
        w = docs[k].split()
        for _ in range(max(1, len(w) // 60)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
        docs.append(" ".join(w))
    docs += ["", "x " * 50, "Ünï cödé — 中文 " * 5, "a.b@mail.example.com +1 (337) 555-0693 10.20.30.40 4442765686694452"]
    return [(k, t) for k, t in enumerate(docs)]


AWKWARD = [(None, "null id text"), (900, None), (901, ""), (902, " \n\t "), (903, "one"), (903, "one"), (904, "z" * 3000), (905, "w " * 3000), (906, "\x00 odd ​ chars \x1c")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token_ids string, leak_n_words int, node string, crc string, ranges int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty, odd, long and repeated rows, and columns named like the operators' own."""
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None, "x", 1, "n", "c", 2) for k, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def frame(spark, corpus):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
