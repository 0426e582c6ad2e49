"""Brute force, very long texts, clashing names and the traces that operators leave."""

import html
import random
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from emberlint.llm import counts as C
from emberlint.llm import decontam as D
from emberlint.llm import htmltext as H
from emberlint.llm import neardup as N
from emberlint.llm import packing as G
from emberlint.llm import pii as P
from emberlint.llm import quality as Q
from emberlint.llm import substring as S
from emberlint.llm import tokens as K
from emberlint.llm import toxicity as X
from emberlint.llm.common import materialise, scratch

WORDS = ["".join(random.Random(k).choices("abdeilmnorstu", k=3 + k % 7)) for k in range(500)]

# --- pages whose main text is known as they are put together

WRAPS = ["wrapper", "wrapper has-sidebar", "page with-nav", "no-sidebar", "comments-open", "social-widget", "notice-period", "skip-to"]
NOISE = [
    lambda t: f'<nav><ul><li><a href="/">{t}</a></ul></nav>', lambda t: f"<aside><p>{t}</p></aside>", lambda t: f'<div class="sidebar"><h3>{t}</h3><p>{t}</div>',
    lambda t: f"<footer>{t}</footer>", lambda t: f'<form action="x"><p>{t}<input name=q></form>', lambda t: f"<script>var s = '<p>{t}</p>';</script>",
    lambda t: f'<div id="cookie-notice">{t}</div>', lambda t: f'<div class="ad banner"><p>{t}</p></div>', lambda t: f'<section class="comments"><article><p>{t}</p></article></section>',
    lambda t: f'<div style="display: none">{t}</div>', lambda t: f"<!-- {t} -->",
]


def _page(rng):
    said = lambda n: " ".join(rng.choices(WORDS, k=n))
    blocks = [said(rng.randint(8, 40)) + rng.choice(["", " & more", " < less", " é"]) for _ in range(rng.randint(2, 6))]
    shown = [rng.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<blockquote>{}</blockquote>", "<h2>{}</h2>"]).format(html.escape(b).replace(" ", rng.choice([" ", "\n", "  "]), 1)) for b in blocks]
    noise = [rng.choice(NOISE)(said(5)) for _ in range(4)]
    article = f'<article class="post-{rng.randint(1, 99)}"><h1>{blocks[0]}</h1>'.replace("&", "&amp;").replace(" < ", " &lt; ") + "".join(shown[1:]) + "</article>"
    return f'<html><head><title>x</title></head><body><header>{said(3)}</header>{noise[0]}<div class="{rng.choice(WRAPS)}">{noise[1]}{article}{noise[2]}</div>{noise[3]}</body></html>', "\n".join(blocks)


def test_pages_put_together():
    rng = random.Random(5)
    for _ in range(300):
        source, want = _page(rng)
        page = H.Page(source)
        assert page.text(page.best()) == want


def test_deep_scopes_take_linear_time():
    began = time.time()
    H.Page("<p><td>" + "<x>" * 100_000 + "<h1></h1>" * 100_000)
    H.Page("<p><td>" * 30_000 + "<x><h1>" * 60_000)
    assert time.time() - began < 30


@pytest.mark.parametrize("piece", ["<a", "<a b='\">", "<a '\"", "</a", "<div>", "<blockquote>", "<p>x</div>", "<li class=ad>", "&amp;<b>", '<a href="'])
def test_long_pages_take_linear_time(piece):
    began = time.time()
    page = H.Page(piece * (400_000 // len(piece)))
    page.text(page.best())
    assert time.time() - began < 20


# --- near copies


def test_many_near_copies(spark):
    rng = random.Random(3)
    base, rows = [rng.choice(WORDS) for _ in range(120)], []
    for k in range(900):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 7])):
            w[rng.randrange(len(w))] = f"{rng.choice(WORDS)}{k}"
        rows.append((k, " ".join(w)))
    rows += [(2000 + k, " ".join(rng.choices(WORDS, k=90))) for k in range(100)]
    sets = {i: N.shingle_set(N.hash_words(t.encode().split(), N.WordHash())) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    index = N.Postings([sets[i] for i in ids])
    for i in ids:
        both = index.shared(sets[i])
        for k in np.flatnonzero(100 * both >= 75 * (index.sizes + len(sets[i]) - both)):
            a, b = root(i), root(ids[k])
            up[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: root(i) for i in ids} and len(set(got.values())) < 700


def test_recall_at_the_threshold():
    """Pairs just at a similarity of 0.75: each shares a band value, and none is dropped by its likelihood."""
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(12, 300))
        common = rng.integers(0, 2**63, 3 * n, np.uint64)
        extra = rng.integers(0, 2**63, n, np.uint64)
        k = int(rng.integers(0, n + 1))
        a, b = np.unique(np.concatenate([common, extra[:k]])), np.unique(np.concatenate([common, extra[k:]]))
        x, y = N.sketch(a), N.sketch(b)
        assert (x.reshape(N.BANDS, -1) == y.reshape(N.BANDS, -1)).all(1).any()
        assert N.plausible([(x > y).sum()], [(x < y).sum()], [len(a)], [len(b)])[0]


def test_most_different_registers():
    larger, smaller = (v.ravel() for v in np.meshgrid(np.arange(N.REGISTERS + 1), np.arange(N.REGISTERS + 1)))
    fits = larger + smaller <= N.REGISTERS
    larger, smaller = larger[fits], smaller[fits]
    for share in np.linspace(0.75, 1, 11):
        ok = N.plausible(larger, smaller, np.full(len(larger), 1000 * share), np.full(len(larger), 1000.0))
        assert (larger + smaller)[ok].max() < N.MOST_DIFFERENT


# --- counts


def test_counts_by_tokenizers(spark, frame, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    versions = {v: public_tokenizers.path(v) for v in C.VOCABULARIES}
    got = {r.doc_id: (r[-2], r[-1]) for r in C.with_token_counts(frame, versions).collect()}
    plain = Tokenizer.from_file(versions[C.VOCABULARIES[0]])
    plain.encode_special_tokens = True
    for i, t in corpus:
        assert got[i][0] == len(plain.encode(t, add_special_tokens=False).ids)
        assert got[i][1] == C._counter(versions[C.VOCABULARIES[1]])(t)


def test_ledger_after_compaction(spark):
    rows = spark.createDataFrame([("a", "en", 5)], "source string, lang string, n long")
    ledger = C.TokenLedger(spark, scratch(spark, "ledger"))
    assert ledger.commit("1", C.inserts(rows, "v", "n"))
    ledger.compact("c")
    again = C.TokenLedger(spark, f"{ledger.path}-c")
    assert not again.commit("1", C.inserts(rows, "v", "n")) and again.totals().first().n_tokens == 5
    assert again.commit("2", C.inserts(rows, "v", "n")) and again.totals().first().n_docs == 2
    again.compact("d")
    third = C.TokenLedger(spark, f"{again.path}-d")
    assert not third.commit("1", C.inserts(rows, "v", "n")) and not third.commit("2", C.inserts(rows, "v", "n"))
    assert third.totals().first().n_tokens == 10


def test_two_writers_of_one_batch(spark):
    rows = spark.createDataFrame([("a", "en", "v", 1, 5)], C.DELTAS)
    ledger = C.TokenLedger(spark, scratch(spark, "ledger"))
    for name in ("x", "y"):
        rows.write.parquet(f"{ledger.path}/.{name}")
    assert ledger._named(f"{ledger.path}/.x", "1") and not ledger._named(f"{ledger.path}/.y", "1")
    assert ledger.totals().first().n_tokens == 5 and ledger.batches() == ["1"]


# --- personal data


@pytest.mark.parametrize(
    "text, kind, said",
    [
        ("account GB82 WEST 1234 5698 7654 32", "iban", "GB82 WEST 1234 5698 7654 32"),
        ("Account number: 12345678, thanks", "account", "12345678"),
        ("sort code 12-34-56", "account", "12-34-56"),
        ("account 2024-2031-77", "account", "2024-2031-77"),
        ('token = "bed4d44cf2780ed3ef0cb916120773181bc8de67" der', "secret", "bed4d44cf2780ed3ef0cb916120773181bc8de67"),
        ("password: hunter22", "secret", "hunter22"),
        ("secret=WerTyuIoPlk", "secret", "WerTyuIoPlk"),
        ("her SSN is 123-45-6789.", "national", "123-45-6789"),
        ("at 742 Evergreen Terrace, Springfield, IL 62704 now", "address", "742 Evergreen Terrace, Springfield, IL 62704"),
        ("221B Baker Street, London NW1 6XE.", "address", "221B Baker Street, London NW1 6XE"),
        ("http://bob:" + "p" * 3000 + "@host/", "login", "bob:" + "p" * 3000),
    ],
)
def test_added_kinds(text, kind, said):
    assert [text[s:e] for s, e in P.find_spans(text)[kind]] == [said]


@pytest.mark.parametrize("text", ["10 Main Road is nice", "an account of 2019", "SSN 000-12-3456", "SSN 666-12-3456", "accounts 12345678", "the Court, 12 Kings",
    "password: required by the form", "The token: something else", "secret = politely kept", "Password: Required always", "account 2024-2025 opened", "account 2024-03-15 opened", "token: 2024-03-15", "secret: aaaaaaaa1aaaaaaaa"])
def test_clean_texts(text):
    found = P.find_spans(text)
    assert not found["account"] and not found["national"] and not found["address"]


# --- long texts, names that clash, files


def test_texts_of_a_megabyte(spark):
    rng = random.Random(1)
    long = " ".join(rng.choices(WORDS, k=200_000))
    rows = [(1, long, "en", "s"), (2, long + " end", "en", "s"), (3, "x" * 1_200_000, "en", "s"), (4, "word " * 240_000, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    assert {r.doc_id: r.component_id for r in N.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in S.remove_repeats(docs).collect()}
    assert removed[1] == (200_000, 0) and removed[2] == (200_001, 200_000) and removed[3] == (1, 0) and removed[4][0] == 240_000
    bench = spark.createDataFrame([(1, " ".join(long.split()[199_980:]))], "item_id long, text string")
    hit = {r.doc_id: sum(s.end - s.start for s in r.leak_hit_spans) for r in D.find_leaks(docs, bench).collect()}
    assert hit == {1: 20, 2: 20, 3: 0, 4: 0}
    assert C.with_token_counts(docs, {"v": K.default_tokenizer()}).where("v > 0").count() == 4
    metrics = {r.doc_id: (r.n_words, r.word_chars, r.n_repeat_words) for r in Q.with_metrics(docs).select("doc_id", *Q.METRICS).collect()}
    assert metrics[3] == (1, 1_200_000, 0) and metrics[4] == (240_000, 960_000, 240_000)
    words = long.split()
    seen = {}
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    again = {x for ks in seen.values() if len(ks) > 1 for k in ks for x in (k, k + 1, k + 2)}
    assert metrics[1] == (200_000, sum(map(len, words)), len(again))
    model = X.Model({"word": 3.0}, frozenset(), -3.0, (2.0, 0.0, 1.0))
    assert {r.doc_id for r in X.score_documents(docs, model).where("toxicity_score > 0.7").collect()} == {4}
    pieces = G.pack_documents(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("pieces")).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4} and all(r.pieces == -(-r.n // G.CAPACITY) for r in pieces)


def test_clashing_names(spark, frame):
    docs = frame.withColumn("toxicity_score", F.lit("mine")).withColumn("crc_of_text", F.lit(1)).withColumn("row", F.lit(2)).withColumn("id", F.lit(3)).withColumn("crc", F.lit(4))
    labels = frame.select("doc_id", (F.col("doc_id") % 7 == 0).cast("int").alias("toxic"))
    scored = X.score_documents(docs, X.fit(docs, labels))
    assert scored.columns.count("toxicity_score") == 1 and scored.where("toxicity_score between 0 and 1").count() == docs.count()
    kept = N.keep_first(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert P.mask_documents(docs).columns == docs.columns


def test_metrics_beside_clashing_columns(spark):
    docs = spark.createDataFrame([("a b", "own", 7, "x", 9)], "text string, _words string, _text long, `_row` string, n_words long")
    (r,) = Q.with_metrics(docs).collect()
    assert r.asDict() == {"text": "a b", "_words": "own", "_text": 7, "_row": "x", "n_words": 2, "word_chars": 2, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0}


def test_no_number_of_documents_changes_the_rule(spark):
    """Thresholds of a group move by little with each document, also where there are about a hundred."""
    text = lambda k: " ".join(f"{w}{'#' * (k % 3 == 0)}" for w in random.Random(k).choices(WORDS, k=80))
    rows = [(k, text(k), "en", "small" if k < 103 else "large") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    rated = materialise(Q.with_ratios(Q.with_metrics(docs).drop("text")), "test-rated")
    highs = []
    for n in (98, 99, 100, 101):
        sketches = materialise(Q.quantile_sketches(rated.where(f"not doc_id between {n} and 102")), "test-sketches")
        (r,) = Q.thresholds(sketches).where("source = 'small'").collect()
        highs.append(r.high_chars_a_word)
    assert max(abs(a - b) for a, b in zip(highs, highs[1:], strict=False)) < 0.05
    assert Q.thresholds(Q.quantile_sketches(rated.limit(0))).count() == 0


def test_scratch_is_removed(spark, frame):
    import os

    def folders():
        return set(os.listdir(f"{spark.conf.get('spark.checkpoint.dir')}/emberlint"))

    materialise(frame.limit(1), "any")
    before = folders()
    N.near_duplicates(frame).count()
    assert len(folders() - before) < 8


def test_footers_of_token_files(spark, frame):
    path = scratch(spark, "tokens")
    K.write_token_files(frame, path)
    files = [f for f in __import__("glob").glob(f"{path}/**/*.parquet", recursive=True)]
    seen = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                if "token_ids" in col.path_in_schema:
                    assert {"PLAIN_DICTIONARY", "RLE_DICTIONARY"} & set(col.encodings)
                    assert col.has_offset_index and col.has_column_index
                    seen += 1
                elif col.physical_type == "INT64":
                    assert "DELTA_BINARY_PACKED" in col.encodings
    assert seen
