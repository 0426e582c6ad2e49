"""Verdicts on URLs: fixed rules first, else a logistic regression on hashed character n-grams, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlint.functions.text import once
from emberlint.llm.common import table
from emberlint.llm.manifest import lower_ascii
from emberlint.llm.retention import crc32_sql

#: (verdict, host, start of the path). A rule fits its host and all subdomains.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Lengths of n-grams, and buckets that they are hashed to.
GRAMS = (2, 3, 4, 5)
BUCKETS = 1 << 13
#: Steps, rate and weight decay of the regression; the score from which a URL is blocked.
STEPS = 200
RATE = 16.0
DECAY = 1e-5
#: What the constant feature is worth beside the n-grams, whose squares sum to 1.
BIAS = 0.1
BLOCK_FROM = 0.5
#: Rows of a labelled table that a model is fitted on, at most: those of least checksum of their URL.
LABELLED_ROWS = 400

# Words of invented hosts that are to be blocked (gambling, drugs, pornography, fraud, advertising, link farms), and of others.
_BLOCKED = (
    "casino slots jackpot poker roulette betting bets gambling lottery win bonus spins pills meds viagra cialis pharmacy drugs diet cheap adult porn sex xxx cams nude erotic dating escort "
    "ads adserver banner track tracker clicks popup pixel spam spammer backlinks farm links seo traffic loans payday cash rich money prize phishing verify-account warez crack keygen torrent "
    "replica fake miracle free deals"
)
_CLEAN = (
    "library news garden docs university museum weather recipes school wiki forum hospital science travel journal railway parliament community history books mountain kitchen project theatre "
    "furniture bicycle music orchestra animals observatory region health stories archive thinking northern other teaching station lighthouse weaving mathematics language village sailing chess "
    "river market bakery students research nation street history winter painting theory thread this that these those there then them they their with another nothing action edition national mother weather-one thousand"
)
_HOSTS = ("{0}-{1}.example.com", "www.{0}{1}.example.net", "m.{0}-{1}.example", "{0}.{1}.example.org", "blog.{0}.example.com", "{1}-{0}.example.net")
_PATHS = ("/", "/en/{0}", "/de/{0}.html", "/fr/{0}/", "/es/{0}", "/index.html", "/a/{0}/b", "")


def _site_urls(words: str, times: int = 2) -> list[str]:
    """URLs of the words in turn with their neighbours: hosts and paths of both labels are formed alike, so only the words differ."""
    w = words.split()
    hosts = [_HOSTS[(i + t * 3 + i // 6) % len(_HOSTS)].format(x, w[(i + 1 + 5 * t) % len(w)]) for t in range(times) for i, x in enumerate(w)]
    return [f"https://{h}{_PATHS[(i + i // 8) % len(_PATHS)].format(37 * i % 1009)}" for i, h in enumerate(hosts)]


_VALUES = ", ".join([f"('{u}', 1)" for u in _site_urls(_BLOCKED)] + [f"('{u}', 0)" for u in _site_urls(_CLEAN)])


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to a slash, question mark or hash, with A-Z in lower case; empty without one."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark or hash, as it is; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, of equally long ones that with the longer host; null if none fits."""
    dotted = F.concat(F.lit("."), host)

    def fitted(verdict: str, name: str, start: str) -> Column:
        fits = F.endswith(dotted, F.lit(f".{name}")) & F.startswith(path, F.lit(start))
        found = F.struct(F.lit(len(name + start)).alias("length"), F.lit(len(name)).alias("of_host"), F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))
        return F.when(fits, found)

    best = F.array_max(F.array(*(fitted(*r) for r in rules)))  # skips nulls
    return F.when(best.isNotNull(), F.struct(best["verdict"].alias("verdict"), best["rule"].alias("rule")))


def grams(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the character n-grams of host and path between two marks, each counted once. Time is linear in the length."""
    chars = F.split(F.concat(F.lit("^"), host, lower_ascii(path), F.lit("$")), "")

    def of(x: Column) -> Column:
        def windows(n: int) -> Column:
            # ``x`` shifted by 1, 2, ... stands beside it, so that no window is cut out of the whole text again.
            ends = F.transform(x, lambda c, k: F.when(k + n <= F.size(x), F.concat(c, *(F.get(x, k + d) for d in range(1, n)))))
            return F.transform(F.filter(ends, lambda w: w.isNotNull()), lambda w: (F.crc32(w) % buckets).cast("int"))

        return F.array_distinct(F.concat(*(windows(n) for n in GRAMS)))

    return once(chars, of)


@dataclass
class UrlModel:
    """Weights of all buckets and a bias: a bounded number of doubles, whatever was scored or fitted."""

    weights: list[float]
    bias: float

    def score(self, host: Column, path: Column) -> Column:
        """Probability, by the model, that a URL is to be blocked. A URL without host and path has the bias alone."""
        # A literal array: the split is folded when the query is planned.
        known = F.split(F.lit(" ".join(map(repr, self.weights))), " ").cast("array<double>")

        def of(found: Column) -> Column:
            total = F.aggregate(found, F.lit(0.0), lambda a, b: a + F.get(known, b))
            return F.lit(self.bias) + total / F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double"))

        return 1 / (1 + F.exp(-once(grams(host, path, len(self.weights)), of)))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked): the small table that the query learns from."""
    return spark.sql(f"SELECT * FROM VALUES {_VALUES} AS t(url, blocked)")


def fit(labelled: DataFrame, buckets: int = BUCKETS, rows: int = LABELLED_ROWS) -> UrlModel:
    """A model from (url, blocked), by gradient descent with weight decay.

    Rows with a null are left out, repeated ones count once; beyond ``rows`` those of least checksum of the URL are taken. As weights are sums of the
    rows' n-grams times a factor for each row, it is these factors that the descent moves: one expression over one
    row that holds the dot products of all pairs of the (at most ``rows``) labelled URLs. Both labels have to occur.
    """
    known = labelled.where("url is not null and blocked is not null").select("url", F.col("blocked").cast("double").alias("y")).distinct()
    known = known.orderBy(F.crc32("url"), "url", "y").limit(rows).select("url", "y", F.array_sort(grams(host_of(F.col("url")), path_of(F.col("url")), buckets)).alias("x"))
    one = known.agg(F.array_sort(F.collect_list(F.struct("url", "y", "x"))).alias("rows"))
    norm = lambda r: F.sqrt(F.greatest(F.size(r["x"]), F.lit(1)).cast("double"))
    dot = F.transform("rows", lambda a: F.transform("rows", lambda b: F.size(F.array_intersect(a["x"], b["x"])) / (norm(a) * norm(b)) + BIAS))

    def descended(dot: Column) -> Column:
        def step(factors: Column, _: Column) -> Column:
            def moved(f: Column, k: Column) -> Column:
                products = F.zip_with(F.get(dot, k), factors, lambda d, g: d * g)
                margin = F.aggregate(products, F.lit(0.0), lambda a, p: a + p)
                return f * (1 - RATE * DECAY) + RATE / F.size("rows") * (F.get("rows", k)["y"] - 1 / (1 + F.exp(-margin)))

            return F.transform(factors, moved)

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.transform("rows", lambda r: F.lit(0.0)), step)

    learned = one.withColumn("factors", once(dot, descended))
    each = learned.select(F.explode(F.arrays_zip("rows", "factors")).alias("z")).select("z.rows", "z.factors")
    parts = each.select(F.explode(F.concat(F.array(F.lit(-1)), "rows.x")).alias("bucket"), (F.col("factors") / norm(F.col("rows"))).alias("part"), "factors")
    sums = parts.groupBy("bucket").agg(F.sum("part").alias("weight"), F.sum("factors").alias("bias")).orderBy("bucket").collect()  # at most ``buckets`` + 1 rows
    by = {r.bucket: r for r in sums}
    if not by:
        raise ValueError("no labelled URL")
    return UrlModel([by[k].weight if k in by else 0.0 for k in range(buckets)], BIAS * by[-1].bias)


def judge(pages: DataFrame, model: UrlModel, rules=RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow or block) and score, the model's, for every row; columns of these names are replaced.

    One pass without a shuffle. URLs that are null or have no ``://`` have an empty host and path, no rule, and the model's verdict on
    nothing. ``rules`` are a list in the program, each a few expressions; a rule's verdict stands whatever the score.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.withColumns({"host": host, "path": path})
    found = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"score": model.score(F.col("host"), F.col("path")), "rule": found["rule"], "verdict": found["verdict"]})
    return rows.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow")))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every row of ``pages``; nulls and rules that tie as ``judge`` and ``rule_for`` say, repeated rows are judged alike."""
    judged = judge(table(spark, sf_dir, "pages", "page_id", "url"), fit(labelled_urls(spark)))
    return judged.select("page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_WINDOWS = "list_concat(" + ", ".join(f"list_transform(range(1, len(c) - {n} + 2), lambda k: array_to_string(c[k : k + {n - 1}], ''))" for n in GRAMS) + ")"

OP12_SQL = f"""
WITH RECURSIVE l AS (SELECT url, CAST(blocked AS DOUBLE) AS y, {_HOST} AS host, {_PATH} AS path FROM (VALUES {_VALUES}) AS t(url, blocked)),
p AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages),
u AS (SELECT host, path FROM l UNION SELECT host, path FROM p),
w AS (SELECT host, path, unnest({_WINDOWS}) AS w
  FROM (SELECT host, path, string_split('^' || host || translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '$', '') AS c FROM u)),
h AS (SELECT w, CAST({crc32_sql("w")} % {BUCKETS} AS INTEGER) AS bucket FROM (SELECT DISTINCT w FROM w)),
x AS (SELECT DISTINCT host, path, bucket FROM w JOIN h ON w.w = h.w),
n AS (SELECT host, path, sqrt(count(*)) AS norm FROM x GROUP BY host, path),
lx AS (SELECT url, y, bucket, norm FROM l JOIN x ON l.host = x.host AND l.path = x.path JOIN n ON l.host = n.host AND l.path = n.path),
g AS (SELECT a.url AS a, b.url AS b, count(*) / (any_value(a.norm) * any_value(b.norm)) AS dot FROM lx a JOIN lx b ON a.bucket = b.bucket GROUP BY a.url, b.url),
d AS (SELECT a.url, any_value(a.y) AS y, list(coalesce(g.dot, 0) + {BIAS} ORDER BY b.url) AS dots FROM l a JOIN l b ON true LEFT JOIN g ON g.a = a.url AND g.b = b.url GROUP BY a.url),
m AS (SELECT list(url ORDER BY url) AS urls, list(y ORDER BY url) AS ys, list(dots ORDER BY url) AS dots FROM d),
f(step, factors) AS (
  SELECT 0, list_transform(ys, lambda y: CAST(0 AS DOUBLE)) FROM m
  UNION ALL SELECT step + 1, list_transform(factors, lambda f, k: f * {1 - RATE * DECAY!r} + {RATE} / len(ys) * (ys[k] - 1 / (1 + exp(-list_dot_product(dots[k], factors))))) FROM f, m WHERE step < {STEPS}
),
a AS (SELECT unnest(urls) AS url, unnest(factors) AS factor FROM f, m WHERE step = {STEPS}),
v AS (SELECT bucket, sum(factor / norm) AS weight FROM lx JOIN a ON lx.url = a.url GROUP BY bucket),
s AS (SELECT n.host, n.path, 1 / (1 + exp(-({BIAS} * (SELECT sum(factor) FROM a) + coalesce(sum(weight), 0) / any_value(norm)))) AS score
  FROM n JOIN x ON n.host = x.host AND n.path = x.path LEFT JOIN v ON x.bucket = v.bucket GROUP BY n.host, n.path),
r AS (SELECT p.host, p.path, arg_max(verdict, (length(name || start), length(name))) AS verdict, arg_max(name || start, (length(name || start), length(name))) AS rule
  FROM (SELECT DISTINCT host, path FROM p) p JOIN (VALUES {_RULE_ROWS}) AS t(verdict, name, start) ON ends_with('.' || p.host, '.' || name) AND starts_with(p.path, start) GROUP BY p.host, p.path)
SELECT page_id, p.host, p.path, r.rule, coalesce(r.verdict, CASE WHEN score >= {BLOCK_FROM} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN r ON p.host = r.host AND p.path = r.path LEFT JOIN s ON p.host = s.host AND p.path = s.path
"""
