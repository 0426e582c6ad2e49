"""Retention, URL filter and manifest: brute force, awkward rows, small blocks and batches."""

import datetime as dt
import hashlib
import math
import random
import re
import zlib

import pytest

from emberlint.llm import manifest as M
from emberlint.llm import retention as R
from emberlint.llm import urlfilter as U

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
DAY = dt.timedelta(days=1)
EPOCH = dt.datetime(1970, 1, 1)


def crc(x):
    return zlib.crc32(str(x).encode())


def plain_retention(clicks, cities):
    cells = {}
    known = {0: {}, 1: {}}
    for click_id, ts, arrived, client, kind, value, _ in set(clicks):
        if ts is None or client is None:
            continue
        late = crc("" if click_id is None else click_id)
        come = arrived and click_id is not None and arrived + (late % 100 * DAY if late % 3 == 0 else 0 * DAY)
        row = (ts, kind, 0 if value is None or value != value else int((100 * value + 0.5) // 1))
        known[1].setdefault(client, []).append(row)
        if come and come < dt.datetime(2024, 3, 1):
            known[0].setdefault(client, []).append(row)
    starts = {s: {c: min(t for t, k, _ in rows if k == "purchase") for c, rows in known[s].items() if any(k == "purchase" for _, k, _ in rows)} for s in known}
    cohort = lambda t: (t - EPOCH) // DAY // 3
    for s, by in starts.items():
        for c, start in by.items():
            moved = int(c in starts[0] and c in starts[1] and cohort(starts[0][c]) != cohort(starts[1][c]))
            periods = {}
            for ts, _, cents in known[s][c]:
                if ts >= start:
                    periods[(ts - start) // (3 * DAY)] = periods.get((ts - start) // (3 * DAY), 0) + cents
            for p, cents in periods.items():
                cell = cells.setdefault((s, cities.get(c) or "", cohort(start), p), [0, 0, 0, 0])
                for k, x in enumerate((1, crc(c), moved, cents)):
                    cell[k] += x
    return sorted((*k, *v) for k, v in cells.items())


def invented_clicks(rng, n, clients, spread=40):
    out = []
    for k in range(n):
        ts = dt.datetime(2024, 2, 1) + dt.timedelta(seconds=rng.randrange(spread) * 86_400 // 2, microseconds=rng.choice([0, 0, 1, 999_999]))
        client = 0 if rng.random() < 0.4 else rng.randrange(clients)
        kind = rng.choice(["purchase", "view", "click", None])
        out.append((k, ts, ts + rng.choice([0, 1, 20]) * DAY, client, kind, rng.choice([None, 1.005, -2.5, 7.25, float("nan")]), rng.choice([None, "{}"])))
    return out


@pytest.mark.parametrize(("shard_clicks", "batch"), [(4096, 10_000), (20, 3), (5, 1)])
def test_retention(spark, shard_clicks, batch):
    rng = random.Random(shard_clicks)
    clicks = invented_clicks(rng, 600, 25)
    rows = clicks + rng.choices(clicks, k=200) + [(k, *clicks[k][1:]) for k in range(5)]
    rows += [(700, None, EPOCH, 3, "purchase", 1.0, None), (701, EPOCH, EPOCH, None, "purchase", 1.0, None), (702, dt.datetime(1969, 12, 30, 5), None, 24, "purchase", 3.0, "x"), (None, EPOCH, EPOCH, 24, "view", 4.0, "y")]
    clients = [(k, None if k % 5 == 0 else f"city{k % 3}", "extra") for k in range(20)] + [(None, "nowhere", "x"), (7, "city1", "again")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = R.retention(spark.createDataFrame(rows, CLICKS), spark.createDataFrame(clients, "client_id long, city string, users string"), shard_clicks=shard_clicks)
        got = sorted(tuple(r) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == plain_retention([(*r[:5], None if r[5] != r[5] else r[5], r[6]) for r in rows], {k: c for k, c, _ in clients})


def test_one_click_many_times(spark):
    """Copies of one row are merged before they meet, a hot client is dealt over shards."""
    one = (3, dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 1), 9, "purchase", 2.0, None)
    rows = [one] * 500 + [(k, dt.datetime(2024, 2, 1, 1), dt.datetime(2024, 2, 1), 9, "view", 1.0, None) for k in range(10, 100)]
    clicks, clients = spark.createDataFrame(rows, CLICKS), spark.createDataFrame([(9, "x")], "client_id long, city string")
    known = R.known_clicks(clicks)
    assert known.count() == 91 and [r.shards for r in R.hot_clients(known, 10).collect()] == [10]
    users = R.users_by_period(known, R.hot_clients(known, 10))
    assert users.count() > 5  # a row for each shard
    assert [tuple(r) for r in R.retention(clicks, clients, shard_clicks=10).where("state = 1").collect()] == [(1, "x", 6584, 0, 1, crc(9), 0, 9200)]


def test_retention_of_nothing(spark):
    clicks, clients = spark.createDataFrame([], CLICKS), spark.createDataFrame([], "client_id long, city string")
    assert R.retention(clicks, clients).collect() == []
    lone = spark.createDataFrame([(1, EPOCH, EPOCH, 1, "view", 1.0, None)], CLICKS)
    assert R.retention(lone, clients).collect() == []


# --- manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes, fan):
    """Levels of digests, lowest first, until one is left."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
    return levels


def plain_manifest(docs, fan, altered):
    by = {}
    for d in docs:
        by.setdefault(d[1], []).append((d[0] is not None, d[0] or 0, plain_leaf(d), d))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])], fan) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names], fan)
    out = []
    for pos, s in enumerate(names):
        for k, (_, _, leaf, d) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            given = plain_leaf((*d[:4], None if d[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in d[4]))) if d[0] is not None and altered(d[0]) else leaf
            said, node = "", given
            for levels, at in ((trees[s], k), (top, pos)):
                for nodes in levels[:-1]:
                    lo = at - at % fan
                    before, after = "".join(nodes[lo:at]), "".join(nodes[at + 1 : lo + fan])
                    said, node, at = said + before + after, sha(before + node + after), at // fan
            out.append((d[0], leaf, trees[s][-1][0], top[-1][0], sha(said), node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("fan", "deep"), [(16, 3), (3, 1), (2, 2)])
def test_manifest(spark, fan, deep):
    rng = random.Random(fan)
    docs = [(k, rng.choice(["hot", "hot", "hot", "b", "é", "", None]), rng.choice([None, "en"]), rng.choice([None, k]), rng.choice([None, "", "Aß x", f"Word {k}", "no capitals"])) for k in range(150)]
    docs += [(5, "hot", None, None, "Twice")] * 20 + [(5, "hot", "x", 1, "other"), (None, "hot", None, None, None), (None, None, None, None, "T"), (400, "lone", "en", 3, "One"), (401, "hot", "en", 9, "Z" * 300_000)]
    df = spark.createDataFrame(docs, DOCS).withColumn("place", M.F.lit("clash")).withColumn("tree", M.F.lit(1)).repartition(5)
    got = M.manifest(df, M.F.crc32(M.F.col("doc_id").cast("string")) % 5 == 0, fan, deep)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_manifest(docs, fan, lambda i: crc(i) % 5 == 0)


def test_manifest_of_little(spark):
    assert M.manifest(spark.createDataFrame([], DOCS)).collect() == []
    (one,) = M.manifest(spark.createDataFrame([(1, "s", "en", 1, "A")], DOCS), M.F.lit(True)).collect()
    assert one.leaf == one.subroot == one.root == plain_leaf((1, "s", "en", 1, "A")) and one.proof_sha256 == sha("") and not one.verified


# --- URL filter

ODD_URLS = [
    None, "", "no scheme", "://", "http://", "http://A.EXAMPLE.Org/es/x?y#z", "https://example.org/en/1", "https://example.org/en/2", "https://badexample.org/es/", "http://org/", "http://org", "http://x.com/fr", "http://x.com/fr/",
    "http://x.com?/de/", "http://x.com#a/de/", "http://x.com/de/://y.org/", "ftp://É.Com:80/de/ü", "a\nb://x.com/de/\nq", "http://notcom/de/", "x://example.org.com/de/1", "HTTP://M.example.org/en/12?u=://z",
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path, rules):
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)
    return (best[0], best[1] + best[2]) if best else (None, None)


class PlainModel:
    """The same regression, by its weights."""

    def __init__(self, labelled):
        rows = [(self.grams(*plain_parts(u)), y) for u, y in labelled]
        self.w, self.bias = {}, 0.0
        for _ in range(U.STEPS):
            slope, constant = {}, 0.0
            for x, y in rows:
                left = y - self.score(x)
                constant += left
                for b in x:
                    slope[b] = slope.get(b, 0) + left / math.sqrt(len(x))
            keep = 1 - U.RATE * U.DECAY
            self.w = {b: self.w.get(b, 0) * keep + U.RATE / len(rows) * slope.get(b, 0) for b in self.w.keys() | slope.keys()}
            self.bias = self.bias * keep + U.BIAS * U.RATE / len(rows) * constant

    @staticmethod
    def grams(host, path):
        s = f"^{host}{path.translate(str.maketrans('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))}$"
        return {zlib.crc32(s[i : i + n].encode()) % U.BUCKETS for n in U.GRAMS for i in range(len(s) - n + 1)}

    def score(self, x):
        return 1 / (1 + math.exp(-self.bias - sum(self.w.get(b, 0) for b in x) / math.sqrt(len(x))))


def test_url_verdicts(spark):
    labelled = [(u, 1) for u in U._site_urls(U._BLOCKED)[:30]] + [(u, 0) for u in U._site_urls(U._CLEAN)[:30]]
    table = spark.createDataFrame([*labelled, labelled[0], (None, 1), ("http://x", None)], "url string, blocked int")
    model, plain = U.fit(table), PlainModel(labelled)
    urls = ODD_URLS + [f"http://{u}" for u in U._BLOCKED.split()[:40:3]] + ["http://x.com/de/" + "long/" * 100_000]
    pages = spark.createDataFrame([(k, u, "clash", 5) for k, u in enumerate(urls)], "page_id long, url string, host string, score int")
    got = {r.page_id: r for r in U.judge(pages, model).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path = plain_parts(u)
        verdict, rule = plain_rule(host, path, U.RULES)
        score = plain.score(plain.grams(host, path))
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].score == pytest.approx(score, abs=1e-9) and got[k].verdict == (verdict or ("block" if score >= 0.5 else "allow"))
    assert U.judge(pages.limit(0), model).count() == 0
    with pytest.raises(ValueError, match="no labelled"):
        U.fit(table.limit(0))


def test_rules_that_tie(spark):
    rules = (("allow", "b.org", "/a"), ("block", "org", "/a/b"), ("block", "a.b.org", "/"))
    df = spark.createDataFrame([("http://a.b.org/a/b",), ("http://b.org/a/b",), ("http://b.org/x",)], "url string")
    rule = U.rule_for(U.host_of(U.F.col("url")), U.path_of(U.F.col("url")), rules)
    assert [r.rule for r in df.select(rule["rule"].alias("rule")).collect()] == ["a.b.org/", "b.org/a", None]


def test_unseen_hosts(spark):
    """Hosts of words that the table has in other company; and no Python in the plan."""
    bad, good = U._BLOCKED.split(), U._CLEAN.split()
    urls = [(f"https://{w}-{w2}.site.example/en/{k}", y) for y, words in ((1, bad), (0, good)) for k, (w, w2) in enumerate(zip(words, words[9:] + words[:9], strict=True))]
    judged = U.judge(spark.createDataFrame(urls, "url string, y int"), U.fit(U.labelled_urls(spark)), rules=[("allow", "none", "/")])
    right = judged.select(((U.F.col("verdict") == "block").cast("int") == U.F.col("y")).cast("double").alias("ok")).agg(U.F.avg("ok")).first()[0]
    assert right > 0.95
    pages = U.op12(spark, "/root/testdata/sf0.001")
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan and "ExistingRDD" not in plan and "html" not in plan
