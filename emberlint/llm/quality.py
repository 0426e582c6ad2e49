"""Quality rules with thresholds that follow the data, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlint.llm.common import materialise, table

SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
REPEATED_PERCENT = 50
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _bits(x: Column, n: Column, left: bool) -> Column:
    return F.call_function("shiftleft" if left else "shiftright", x, n)


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long); null texts count as empty.

    Columns of ``docs`` that have these names are replaced, others are kept whatever their names.
    Windows of three words that occur twice are found by one sort in each row: a window's hash and its place share
    a long, the place in as many low bits as the text needs, so equal windows stand together after sorting. Windows
    whose shortened hashes meet are then sorted by their words, so only equal words count.
    """
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    kept = [c for c in docs.columns if c not in METRICS]
    # The row's own columns wait in a struct, so that none can clash with a step's.
    rows = docs.select((F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.lit(None)).alias("_row"), said.alias("_text")).withColumn("_words", F.regexp_extract_all("_text", F.lit(f"([^{SPACE}]+)"), F.lit(1))).withColumn("_lines", lines)
    windows = F.size("_words") - 2
    rows = rows.withColumn("_bits", F.length(F.bin(F.greatest(windows, F.lit(1)).cast("long"))))
    word = lambda k: F.get("_words", k)
    key = lambda k: _bits(F.xxhash64(word(k), word(k + 1), word(k + 2)), F.col("_bits"), True).bitwiseOR(k.cast("long"))
    rows = rows.withColumn(
        "_keys", F.sort_array(F.when(windows > 1, F.transform(F.sequence(F.lit(0), windows - 1), key)).otherwise(F.array().cast("array<bigint>")))
    )
    same = lambda x, k: _bits(x, F.col("_bits"), False) == _bits(F.get("_keys", k), F.col("_bits"), False)
    met = F.filter("_keys", lambda x, k: same(x, k - 1) | same(x, k + 1))
    mask = _bits(F.lit(1).cast("long"), F.col("_bits"), True) - 1
    at = lambda k: F.struct(word(k).alias("a"), word(k + 1).alias("b"), word(k + 2).alias("c"), k.cast("long").alias("k"))
    rows = rows.withColumn("_met", F.sort_array(F.transform(met, lambda x: at(x.bitwiseAND(mask).cast("int")))))
    equal = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    again = F.filter("_met", lambda x, k: equal(x, F.get("_met", k - 1)) | equal(x, F.get("_met", k + 1)))
    rows = rows.withColumn("_again", F.sort_array(F.transform(again, lambda x: x["k"])))
    zero = F.lit(0).cast("long")
    covered = F.aggregate(
        "_again",
        F.struct(zero.alias("n"), zero.alias("end")),
        lambda a, k: F.struct((a["n"] + k + 3 - F.greatest(k, a["end"])).alias("n"), (k + 3).alias("end")),
        lambda a: a["n"],
    )
    numbers = (
        F.size("_words").cast("long"),
        F.length(F.array_join("_words", "")).cast("long"),
        F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("long"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        covered,
    )
    return rows.select(*(F.col("_row")[c].alias(c) for c in kept), *(x.alias(c) for x, c in zip(numbers, METRICS, strict=True)))


#: Ratios that thresholds are kept for, with the least spread that counts as one (a ratio that is 0 nearly everywhere has none).
RATIOS = {"symbols_a_word": 0.05, "repeated_share": 0.05, "duplicate_lines_a_word": 0.005, "chars_a_word": 0.2}
#: Bins of a sketch are as wide as a least spread by so many, and wider in proportion to values beyond eight such spreads.
BINS = 1024
_EXACT_BITS = 13
#: A group's quartiles are weighed by its documents, those of its language as so many, and the language's likewise with those of all.
PRIOR = 100
#: A document is out if a ratio is further than so many quartile ranges outside of the quartiles.
REACH = 6.0


def with_ratios(metrics: DataFrame) -> DataFrame:
    words = F.greatest("n_words", F.lit(1)).cast("double")
    return metrics.withColumns(
        {
            "symbols_a_word": F.col("n_symbols") / words,
            "repeated_share": F.col("n_repeat_words") / words,
            "duplicate_lines_a_word": F.col("n_dup_lines") / words,
            "chars_a_word": F.col("word_chars") / words,
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")),
        }
    )


def _bin(value: Column, least: float) -> Column:
    """The number of a value's bin: its first 13 bits in units of a bin's width, so bins are few however far values reach."""
    units = F.floor(value * (BINS / least)).cast("long")
    over = F.greatest(F.length(F.bin(units)) - _EXACT_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", units, over), over)


def _sketched(bins: DataFrame, *by: str) -> DataFrame:
    parts = F.struct("bin", "n", "least")
    return bins.groupBy(*by).agg(
        F.sum(F.when(F.col("ratio") == next(iter(RATIOS)), F.col("n"))).alias("n"),
        *(F.array_sort(F.collect_list(F.when(F.col("ratio") == r, parts))).alias(r) for r in RATIOS),
    )


def quantile_sketches(rated: DataFrame) -> DataFrame:
    """A row for each lang and source, nulls included, and none for no documents: n and a mergeable quantile sketch of each ratio, over documents that pass the base rules.

    A sketch is a sorted array of bins (bin, n, least value), some hundred thousand at most. Ranks are exact; a quantile is the
    least value of its bin, so it is low by less than 1 / 1024 of the ratio's least spread, or than 1 / 4096 of itself if that is
    more. Sums and minima merge in any order, so that tasks that run again, or other partitions, give the same sketch.
    """
    values = F.inline(F.array(*(F.struct(F.lit(r).alias("ratio"), F.col(r).alias("value"), _bin(F.col(r), least).alias("bin")) for r, least in RATIOS.items())))
    bins = rated.where("not base_failed").select("lang", "source", values).groupBy("lang", "source", "ratio", "bin")
    return _sketched(bins.agg(F.count("*").alias("n"), F.min("value").alias("least")), "lang", "source")


def merged_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of larger groups, from those of their parts alone; documents aren't read again. Null is a value of ``by`` like any other; without parts there are no groups."""

    def named(r: str) -> Column:
        return F.transform(r, lambda x: F.struct(F.lit(r).alias("ratio"), x["bin"].alias("bin"), x["n"].alias("n"), x["least"].alias("least")))

    bins = sketches.select(*by, F.inline(F.concat(*map(named, RATIOS)))).groupBy(*by, "ratio", "bin")
    return _sketched(bins.agg(F.sum("n").alias("n"), F.min("least").alias("least")), *by)


def _quantile(sketch: Column, n: Column, p: float) -> Column:
    """The least value of the first bin with ``p`` of all values up to its end; null without values."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("double").alias("value"))

    def step(a: Column, x: Column) -> Column:
        upto = a["upto"] + x["n"]
        return F.struct(upto.alias("upto"), F.coalesce(a["value"], F.when(upto >= n * p, x["least"])).alias("value"))

    return F.aggregate(sketch, start, step, lambda a: a["value"])


def thresholds(sketches: DataFrame) -> DataFrame:
    """(lang, source, low_<ratio>, high_<ratio>) for every group of ``sketches``; none for none.

    Quartiles are drawn towards those of the group's language as if ``PRIOR`` more documents had these, and the language's
    towards those of all, so that a small group doesn't vouch for itself and no number of documents changes the rule. Null
    is a language or a source like any other.
    """

    def quartiles(level: DataFrame, *by: str) -> DataFrame:
        return level.select(*by, "n", *(_quantile(F.col(r), F.col("n"), p).alias(f"{r}_{k}") for r in RATIOS for k, p in enumerate((0.25, 0.75))))

    def drawn(level: DataFrame, wider: DataFrame, met: Column) -> DataFrame:
        both = level.alias("g").join(wider.alias("w"), met)
        names = [f"{r}_{k}" for r in RATIOS for k in (0, 1)]
        mixed = [((F.col("g.n") * F.col(f"g.{x}") + PRIOR * F.col(f"w.{x}")) / (F.col("g.n") + PRIOR)).alias(x) for x in names]
        return both.select(*(f"g.{c}" for c in level.columns if c not in names), *mixed)

    by_lang = merged_sketches(sketches, "lang")
    of_all = F.broadcast(quartiles(merged_sketches(sketches)))  # one row
    langs = drawn(quartiles(by_lang, "lang"), of_all, F.lit(True))
    groups = drawn(quartiles(sketches, "lang", "source"), langs, F.expr("g.lang <=> w.lang"))
    limits = []
    for r, least in RATIOS.items():
        spread = REACH * F.greatest(F.col(f"{r}_1") - F.col(f"{r}_0"), F.lit(least))
        limits += [(F.col(f"{r}_0") - spread).alias(f"low_{r}"), (F.col(f"{r}_1") + spread).alias(f"high_{r}")]
    return groups.select("lang", "source", *limits)


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row.

    ``docs`` has doc_id, text, lang and source; other columns are ignored. Null texts have no words and fail the
    base rules. A null lang or source is a group of its own. A group without a document that passes the base
    rules needs no thresholds.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    rated = materialise(with_ratios(with_metrics(plain).drop("text")), "quality-metrics")
    limits = materialise(thresholds(materialise(quantile_sketches(rated), "quality-sketches")), "quality-thresholds")
    inside = F.lit(True)
    for r in RATIOS:
        inside = inside & F.col(f"d.{r}").between(F.col(f"t.low_{r}"), F.col(f"t.high_{r}"))
    same = F.expr("d.lang <=> t.lang and d.source <=> t.source")
    return rated.alias("d").join(limits.alias("t"), same, "left").select(
        "d.doc_id", *(f"d.{c}" for c in METRICS), "d.base_failed", (~F.col("d.base_failed") & F.coalesce(inside, F.lit(True))).alias("kept")
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and verdicts of each row of ``documents``; null and empty texts have no words and fail, values at a threshold pass, repeated rows are judged alike."""
    return judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), win AS (
  SELECT doc_id, k, words[k] AS a, words[k + 1] AS b, words[k + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS k FROM w)
), again AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM again) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len([x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')])
      - len(list_distinct([x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')])) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id
), r AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_symbols / greatest(n_words, 1)::DOUBLE AS r1, n_repeat_words / greatest(n_words, 1)::DOUBLE AS r2,
    n_dup_lines / greatest(n_words, 1)::DOUBLE AS r3, word_chars / greatest(n_words, 1)::DOUBLE AS r4
  FROM m
), q AS (
  SELECT lang, source, grouping(lang) AS gl, grouping(source) AS gs, count(*) AS n,
    quantile_disc(r1, [0.25, 0.75]) AS q1, quantile_disc(r2, [0.25, 0.75]) AS q2, quantile_disc(r3, [0.25, 0.75]) AS q3, quantile_disc(r4, [0.25, 0.75]) AS q4
  FROM r WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source), (lang), ())
), l AS (
  SELECT g.lang,
    [(g.n * g.q1[1] + 100 * w.q1[1]) / (g.n + 100), (g.n * g.q1[2] + 100 * w.q1[2]) / (g.n + 100)] AS q1,
    [(g.n * g.q2[1] + 100 * w.q2[1]) / (g.n + 100), (g.n * g.q2[2] + 100 * w.q2[2]) / (g.n + 100)] AS q2,
    [(g.n * g.q3[1] + 100 * w.q3[1]) / (g.n + 100), (g.n * g.q3[2] + 100 * w.q3[2]) / (g.n + 100)] AS q3,
    [(g.n * g.q4[1] + 100 * w.q4[1]) / (g.n + 100), (g.n * g.q4[2] + 100 * w.q4[2]) / (g.n + 100)] AS q4
  FROM (SELECT * FROM q WHERE gl = 0 AND gs = 1) g CROSS JOIN (SELECT * FROM q WHERE gl = 1 AND gs = 1) w
), t AS (
  SELECT g.lang, g.source,
    [(g.n * g.q1[1] + 100 * w.q1[1]) / (g.n + 100), (g.n * g.q1[2] + 100 * w.q1[2]) / (g.n + 100)] AS q1,
    [(g.n * g.q2[1] + 100 * w.q2[1]) / (g.n + 100), (g.n * g.q2[2] + 100 * w.q2[2]) / (g.n + 100)] AS q2,
    [(g.n * g.q3[1] + 100 * w.q3[1]) / (g.n + 100), (g.n * g.q3[2] + 100 * w.q3[2]) / (g.n + 100)] AS q3,
    [(g.n * g.q4[1] + 100 * w.q4[1]) / (g.n + 100), (g.n * g.q4[2] + 100 * w.q4[2]) / (g.n + 100)] AS q4
  FROM (SELECT * FROM q WHERE gl = 0 AND gs = 0) g JOIN l w ON g.lang IS NOT DISTINCT FROM w.lang
)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(
    r1 BETWEEN q1[1] - 6.0 * greatest(q1[2] - q1[1], 0.05) AND q1[2] + 6.0 * greatest(q1[2] - q1[1], 0.05)
    AND r2 BETWEEN q2[1] - 6.0 * greatest(q2[2] - q2[1], 0.05) AND q2[2] + 6.0 * greatest(q2[2] - q2[1], 0.05)
    AND r3 BETWEEN q3[1] - 6.0 * greatest(q3[2] - q3[1], 0.005) AND q3[2] + 6.0 * greatest(q3[2] - q3[1], 0.005)
    AND r4 BETWEEN q4[1] - 6.0 * greatest(q4[2] - q4[1], 0.2) AND q4[2] + 6.0 * greatest(q4[2] - q4[1], 0.2), true) AS kept
FROM r LEFT JOIN t ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source
"""
