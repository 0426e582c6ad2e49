"""Toxicity, decontamination, pages, near-duplicates, substrings and the pipeline against plain Python."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlint.llm import decontam as D
from emberlint.llm import graph as G
from emberlint.llm import htmltext as H
from emberlint.llm import neardup as N
from emberlint.llm import substring as S
from emberlint.llm import toxicity as X

# --- toxicity


@pytest.mark.parametrize("said", ["IDIOT", "1d10t", "іdіоt", "ｉｄｉｏｔ", "id​iot", "!d!0t"])
def test_folding(said):
    assert X.fold(said) == X.fold("idiot")


def test_folding_leaves_numbers():
    assert X.fold("in 2024, 10") == "in 2024, 10" and X.fold(None) == ""


def _labelled(spark, n=900):
    rng = random.Random(2)
    words = ["".join(rng.choices("abdeiou", k=rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for k in range(n):
        w = rng.choices(words, k=rng.randint(10, 80))
        toxic = k % 5 == 0
        if toxic:
            w += rng.choices(["moron", "idiot", "zorgle", "zorglun"], k=3)
        elif k % 7 == 0:
            w += ["tidy"]
        rng.shuffle(w)
        docs.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = _labelled(spark)
    model = X.fit(docs, labels)
    rows = X.score_documents(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()
    assert len(rows) > 200 and all((r.toxicity_score >= X.THRESHOLD) == (r.toxic == 1) for r in rows)
    assert model.score("you 1d10t you m0ron") > model.score("you there") and 0 <= model.score(None) <= 1
    kept = X.keep_clean(docs.withColumn("toxicity_score", F.lit(1)), model)
    assert kept.count() == labels.where("toxic = 0").count() and kept.columns == ["doc_id", "text", "toxicity_score"]


def test_words_of_any_length():
    """Nothing in a lexicon depends on how long a word is."""
    long = "b" * 300
    assert long in X.terms_of(f"x {long} y") and X.contexts(f"{long} word, {long}", 301) == [(long, True), (long, False)]


def test_exceptions_do_not_count():
    model = X.Model({"idiot": 3.0}, frozenset({("idiot", "savant", False)}), -3.0, (2.0, 0.0, 1.0))
    assert model.score("an idiot savant") < 0.5 < model.score("an idiot")


@pytest.mark.parametrize("said", ["a55", "a$$", "hat3", "you hat3!", "a$$!!", "naz! scum", "naz1", "hate!", "h4t3, 10"])
def test_stand_ins_at_word_ends(said):
    model = X.Model({"ass": 3.0, "hate": 3.0, "nazi": 3.0}, frozenset({("hate", "speech", False)}), -3.0, (2.0, 0.0, 1.0))
    assert model.score(said) > 0.5
    assert all(model.score(x) < 0.5 for x in ("455", "4 55", "in 2024!", "hat 3", "a 55", "hate speech!", "hat3 speech!", "hat3 sp33ch"))


@settings(max_examples=200, deadline=None)
@given(st.text("abi .-é", max_size=40), st.dictionaries(st.from_regex(r"\A[abi]{1,5}\*?\Z"), st.sampled_from([1.5, 2.0, 3.0, 4.0]), max_size=8))
def test_matches_are_those_of_a_plain_search(text, weights):
    """The automaton finds at each word's start the heaviest term that stands there, and scores by these only."""
    model, folded, want = X.Model(weights, frozenset(), -2.0, (1.0, 0.5, 0.25)), X.fold(text), {}
    for at in range(len(folded)):
        if at and folded[at - 1].isalnum():
            continue
        for term, weight in weights.items():
            end = at + len(term.rstrip("*"))
            if folded[at:end] == term.rstrip("*") and (term[-1] == "*" or end == len(folded) or not folded[end].isalnum()):
                want[at] = max(weight, want.get(at, 0.0))
    assert {at: weights[t] for at, t in model.hits(folded)} == want
    total, n = sum(want.values()), folded.count(" ") + 1
    z = -2.0 + np.log1p(total) + 0.5 * total / np.sqrt(n) + 0.25 * max(want.values(), default=0.0)
    assert abs(model.score(text) - 1 / (1 + np.exp(-z))) < 1e-12


def test_toxicity_awkward(spark, awkward, empty):
    _, labels = _labelled(spark, 10)
    for rows in (labels.limit(0), labels.where("toxic = 0"), spark.createDataFrame([(None, 1), (1, None)], labels.schema)):
        model = X.fit(awkward, rows)
        assert all(0 <= r.toxicity_score <= 1 for r in X.score_documents(awkward, model).collect())
    assert X.score_documents(empty, model).count() == 0


# --- decontamination


def plain_leaks(text, items, window):
    words = D.words_of((text or "").encode())
    hit, own = [False] * len(words), set()
    for item, said in items:
        w = D.words_of((said or "").encode())
        for k in range(max(1, len(w) - window + 1) if w else 0):
            p = w[k : k + window]
            for at in range(len(words) - len(p) + 1):
                if words[at : at + len(p)] == p:
                    hit[at : at + len(p)] = [True] * len(p)
                    own.add(item)
    return len(words), sum(hit), sorted(str(x) for x in own if x is not None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=14), max_size=4), st.lists(st.lists(st.sampled_from("abcdz"), max_size=50), max_size=5), st.integers(2, 10))
def test_index_finds_all(items, texts, window):
    items = [(str(k), " ".join(x).encode()) for k, x in enumerate(items)]
    texts = [" ".join(x).encode() for x in texts]
    n, spans, own = D.shard_hits(texts, D.Phrases(items, window))
    for t, a, s, o in zip(texts, n, spans, own, strict=True):
        assert (a, sum(y - x for x, y in s), sorted(o)) == plain_leaks(t.decode(), [(i, x.decode()) for i, x in items], window)


def test_leaks_in_blocks(spark, frame, corpus, awkward, empty):
    items = [(1, " ".join(corpus[40][1].split()[3:30])), (2, corpus[21][1]), (3, None), (None, corpus[31][1][:200]), (4, "one"), (2, "second text of two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (D.BLOCK_BYTES, 60):
        got = {r.doc_id: r for r in D.find_leaks(frame, bench, block_bytes=block).collect()}
        for i, t in corpus:
            n, hit, own = plain_leaks(t, items, D.WINDOW)
            assert (got[i].leak_n_words, sum(s.end - s.start for s in got[i].leak_hit_spans), list(got[i].leak_hit_items)) == (n, hit, own)
    assert D.find_leaks(awkward, bench).count() == awkward.count() and D.find_leaks(empty, bench).count() == 0
    assert D.find_leaks(frame, bench.limit(0)).where("size(leak_hit_spans) > 0").count() == 0
    cut = D.decontaminate(awkward, bench)
    assert cut.columns == [c for c in awkward.columns if c != "leak_n_words"] and 903 not in {r.doc_id for r in cut.collect()}


def test_cut_words():
    assert D.cut_words("One, two three! four", [(1, 3)]) == "One, ! four"
    assert D.cut_words("É a b", [(0, 2)]) == " b"


# --- pages

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>menu</a></nav><div class="ad-banner">Buy</div>
<div class="post-12 main"><h1>Title &amp; more</h1><p>First <b>bold</b>
text&nbsp;here.<br>Next<p>Second <i>one</i></p><ul><li>x<li>y</ul><form><p>Sign</p></form><script>var t="</p>"</script><section class="comments"><p>Reader says a lot of things here</p></section></div>
<aside><p>side</p></aside><footer>f</footer></body></html>"""


def test_page():
    page = H.Page(PAGE)
    assert page.text(page.best()) == "Title & more\nFirst bold text here. Next\nSecond one\nx\ny"


@pytest.mark.parametrize("source, text", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<div>a < b & c</div>", "a < b & c"), ("<!-- x", ""), ('<p a="x>y', "y"), ("<article><p>é&eacute;", "éé"), ("<nav>only menu</nav>", "")])
def test_odd_pages(source, text):
    page = H.Page(source)
    assert (page.text(page.best()) or "").replace('<p a="x>', "") == text


def test_consensus(spark):
    body = "".join(f"<p>{'long text of the page ' * 4}{k}</p>" for k in range(3))
    pages = [(k, "http://a.com/x", f'<body><div class="content c{k}"><p>{k}</p>{body}</div><div class="rel">short</div></body>') for k in range(5)]
    pages.append((9, "http://a.com/y", '<body><div class="c9 content"><p>tiny</p></div><div class="rel"><p>This is a much longer piece of text that no other page has at all</p></div></body>'))
    pages += [(10, None, None), (11, "no host", "<p>x</p>"), (None, "http://b.com", "")]
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in H.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[9][1] == "tiny" and got[10] == (None, "", 0) and got[11][1] == "x" and got[None][1] == ""
    assert got[0][1].startswith("0\nlong text")
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _site(template, url):
    """Three pages of one template, and one more whose own best container is a long block beside it."""
    body = "".join(f"<p>{'long text of the page ' * 4}{k}</p>" for k in range(3))
    rest = '<div class="rel"><p>This is a much longer piece of text that no other page has at all</p></div></div></body>'
    pages = [(url, f'<body><div class="w {template}"><div class="content"><p>{k}</p>{body}</div><div class="rel">short</div></div></body>') for k in range(3)]
    return [*pages, (url, f'<body><div class="w {template}"><div class="content"><p>tiny {template}</p></div>{rest}')]


@pytest.mark.parametrize("most", [0, H.BROADCAST_PATHS])
def test_consensus_of_every_template(spark, monkeypatch, most):
    monkeypatch.setattr(H, "BROADCAST_PATHS", most)
    names = ["".join(x) for x in itertools.product("abc", repeat=3)]
    pages = [(4 * k + j, *p) for k, t in enumerate(names) for j, p in enumerate(_site(t, "http://a.com/x"))]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[4 * k + 3] for k in range(len(names))] == [f"tiny {t}" for t in names]
    assert len(got) == len(pages)


def test_pages_without_host_are_not_pooled(spark):
    pages = [(k, *p) for k, p in enumerate([*_site("x", None), *_site("x", "/relative")])]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == got[7] and got[3].startswith("tiny x\nThis is a much longer")


# --- near-duplicates


def plain_groups(rows):
    sets, up = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        up[i] = i

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def _family(rng, n, words=60, edits=4):
    base = [f"w{rng.randint(0, 999)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"w{rng.randint(0, 999)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates(spark, frame, corpus, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)  # so that the families are cut into blocks
    rng = random.Random(11)
    rows = [*corpus, *((1000 + k, t) for k, t in enumerate(_family(rng, 60) + _family(rng, 5, 200, 9) + ["A b C d"] * 3 + ["a B c d"]))]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == plain_groups(rows)


def test_near_duplicates_awkward(awkward, empty):
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(awkward).collect()), key=str)
    assert (900, 0, 900, True) in rows and rows.count((903, 1, 903, True)) == 2 and (None, 1, None, True) in rows
    kept = N.keep_first(awkward)
    assert kept.count() == awkward.count() - 1 and kept.columns == awkward.columns
    assert N.near_duplicates(empty).count() == 0 and N.keep_first(empty).count() == 0


def test_members_meet_in_small_tiles(spark):
    """Members of different labels meet in a tile; no tile holds much more than two blocks, whoever the visitors are."""
    label = {f"n{k}": 0 if k < 900 else k % 700 for k in range(3000)}
    members = spark.createDataFrame([(1, n.encode(), v) for n, v in label.items()], "cluster long, node binary, label long")
    tiles = defaultdict(lambda: ([], []))
    for r in N.dealt(members, "cluster", F.ceil(F.col("size") / N.BLOCK)).collect():
        tiles[r.block, r.part][r.turn == 2].append((bytes(r.node).decode(), r.turn))
    assert max(len(a) + len(b) for a, b in tiles.values()) < 3 * N.BLOCK
    met = set()
    for (_, part), (home, visitors) in tiles.items():
        ask = visitors + [x for x in home if x[1] == 1 and part == 0]
        met.update(frozenset((a, b)) for a, _ in ask for b, _ in home if label[a] != label[b])
    n, sizes = len(label), Counter(label.values())
    assert len(met) == (n * n - sum(v * v for v in sizes.values())) // 2


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, 3000, np.uint64)) for _ in range(2))
    union = np.unique(np.concatenate([a, b]))
    assert (N.merge(N.sketch(a), N.sketch(b)) == N.sketch(union)).all()
    both = np.unique(np.concatenate([a, b[:900]]))
    equal = (N.sketch(a) == N.sketch(both)).mean()
    assert abs(equal - len(a) / len(both)) < 0.15
    x, y = N.sketch(a), N.sketch(both)
    assert N.plausible([(x > y).sum()], [(x < y).sum()], [len(a)], [len(both)])[0]
    x, y = N.sketch(a), N.sketch(b)
    assert not N.plausible([(x > y).sum()], [(x < y).sum()], [len(a)], [len(b)])[0]


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = {"path": [(k, k + 1) for k in range(40)], "star": [(9, k) for k in range(40)], "random": [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)], "none": []}[kind]
    rng.shuffle(edges)
    forest = G.Forest()
    for e in edges:
        forest.join(*e)
    got = {r.node: r.root for r in G.components(spark.createDataFrame([*edges, (None, 1), (5, 5)], "a long, b long"), "t").collect()}
    assert got == {x: forest.root(x) for e in edges for x in e if e[0] != e[1]}


# --- substrings


def plain_removal(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_substrings(spark, corpus, letters):
    rng = random.Random(letters)
    base = [" ".join(rng.choices([f"v{k}" for k in range(letters)], k=rng.randint(0, 70))) for _ in range(10)]
    rows = [*corpus, *((2000 + k, rng.choice(base) + " " + rng.choice(base)) for k in range(40))]
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == plain_removal(rows, S.WINDOW)


def test_substrings_awkward(awkward, empty):
    rows = {r.doc_id: (r.n_words, r.n_removed) for r in S.remove_repeats(awkward).collect()}
    assert rows[900] == (0, 0) and rows[905] == (3000, 2999) and rows[None] == (3, 0)
    assert S.remove_repeats(awkward).count() == awkward.count() and S.remove_repeats(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=20, max_size=60), st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30))
def test_equal_windows_have_equal_keys(shared, before, after):
    one, two = np.array(shared, np.uint64) + 7, np.array([*before, *shared, *after], np.uint64) + 7
    words, ends = np.concatenate([one, two]), np.array([len(one), len(one) + len(two)])
    start, many, key, _ = S.segments(words, words * 3, ends)
    of = {int(s) + k: int(x) for s, n, x in zip(start, many, key, strict=True) for k in range(n)}
    for k in range(len(one) - S.WINDOW + 1):
        assert of[k] == of[len(one) + len(before) + k]


def test_shared_passages_share_names():
    """Blocks within a shared passage have one name in all texts, others' names differ; names rest on the reach alone."""
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 1 << 63, 60, np.uint64)
    texts = [np.concatenate([rng.integers(0, 1 << 63, rng.integers(5, 40), np.uint64), passage, rng.integers(0, 1 << 63, 30, np.uint64)]) for _ in range(6)]
    ends = np.cumsum([len(t) for t in texts])
    words = np.concatenate(texts)
    lo, hi, name = S.recompress(words, ends)
    named, reach = defaultdict(set), defaultdict(set)
    for a, b, x in zip(lo.tolist(), hi.tolist(), name.tolist(), strict=True):
        if a >= 0 and b <= len(words):
            named[x].add(tuple(words[a:b].tolist()))
            reach[tuple(words[a:b].tolist())].add(x)
    assert all(len(v) == 1 for v in named.values())
    inside = [x for x, v in named.items() if set(next(iter(v))) <= set(passage.tolist())]
    assert len(inside) >= 5 and all((name == np.uint64(x)).sum() == 6 for x in inside)


# --- pipeline


def test_pipeline_is_its_stages(spark):
    """The stages' decisions, taken again in plain Python from each stage's own input."""
    import corpus_pipeline as C
    from emberlint.llm import packing, pii, tokens
    from emberlint.llm.common import materialise, table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    labels, bench = table(spark, sf, "labels", "doc_id", "toxic"), [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    at = [docs]
    for name, stage in C.STAGES[:-1]:
        at.append(materialise(stage(spark, at[-1], sf), f"test-{name}"))
        assert at[-1].columns == docs.columns
    texts = [{r.doc_id: r.text for r in x.collect()} for x in at]
    model = X.fit(docs.select("doc_id", "text"), labels)
    assert texts[1] == {i: t for i, t in texts[0].items() if model.score(t) < X.THRESHOLD}
    groups = plain_groups(list(texts[1].items()))
    assert texts[2] == {i: t for i, t in texts[1].items() if groups[i][1] == i}
    want = {}
    for i, t in texts[2].items():
        n, hit, _ = plain_leaks(t, bench, D.WINDOW)
        if hit < n or not hit:
            want[i] = n - hit
    assert {i: len(D.words_of(t.encode())) for i, t in texts[3].items()} == want
    assert all(plain_leaks(t, bench, D.WINDOW)[1] == 0 or texts[2][i] != t for i, t in texts[3].items())
    assert texts[4] == {i: pii.mask(t) for i, t in texts[3].items()}
    assert {r.doc_id: r.n_chars for r in at[4].collect()} == {i: len(t) for i, t in texts[4].items()}
    rows, sequences = C.STAGES[-1][1](spark, at[4], sf).collect(), defaultdict(int)
    for r in rows:
        sequences[r.sequence_id] += r.length
    assert max(sequences.values()) <= packing.CAPACITY
    lengths = Counter()
    for r in rows:
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(tokens.encode(t, tokens.default_tokenizer())) // 4 + 1 for i, t in texts[4].items()}
    assert C.run(spark, sf).count() == len(rows)


def test_digests(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = plain_removal(list(docs.items()), S.WINDOW)
    for r in S.op8(spark, sf).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == (*want[r.doc_id][:2], hashlib.sha256(want[r.doc_id][2]).hexdigest())
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in D.op2(spark, sf).collect():
        n, hit, own = plain_leaks(docs[r.doc_id], bench, D.WINDOW)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), hit > 0)
    for r in X.op1(spark, sf).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)
