"""Toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters, digits that stand for letters, invisible characters), then an
Aho-Corasick pass finds lexicon terms at word starts, and another where words end in stand-ins. Occurrences inside exception phrases don't count. The
weights found, normalised by the text's length, go through a logistic curve.

Everything is learned from labelled rows: terms are word beginnings of 3 to 10 letters and whole words,
weighted by log odds and kept if a likelihood-ratio test, corrected for the number of terms tried, holds;
exception phrases are a term with a neighbouring word that turn up in clean texts instead; the curve
is fitted on three numbers a row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlint.llm.common import bounded_batches, materialise, table

#: Labelled rows that a model is fitted on, at most (about: chosen by a hash of doc_id).
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
PREFIXES = range(3, 11)

#: Letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ⅰ": "i", "ⅼ": "l", "ɑ": "a", "ѵ": "v", "ʟ": "l", "ѡ": "w",
}
#: Characters that stand for letters within words.
SUBSTITUTES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"})
_TABLE = {ord(k): v for k, v in LOOKALIKES.items()} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_TABLE |= {0xFF21 + k: chr(97 + k) for k in range(26)} | {0xFF41 + k: chr(97 + k) for k in range(26)} | {0xFF10 + k: chr(48 + k) for k in range(10)}
_TABLE |= {ord("l"): "i"}  # 1 stands for i and for l, so the two are one letter
_STANDINS = re.compile(r"[0-9@$!|]+")
_WORD = re.compile(r"[^\W_]+")
_WORD_AFTER = re.compile(r"[\W_]{1,4}([^\W_]+)")
_GAP_BEFORE = re.compile(r"(?<=[^\W_])[\W_]{1,4}\Z")


def _standin(m: re.Match) -> str:
    text, end = m.string, m.end()
    return m[0].translate(SUBSTITUTES) if end < len(text) and text[end].isalpha() else m[0]


def fold(text: str | None) -> str:
    """Lower case with look-alikes, stand-in digits and invisible characters undone; null is empty."""
    return _STANDINS.sub(_standin, (text or "").lower().translate(_TABLE))


def readings(folded: str) -> list[str]:
    """A folded text, and, where stand-ins after a letter end words, the text with those undone, too.

    Marks at a word's end may be letters or punctuation, so they are read as both. Places are the same in all readings.
    """
    runs = [m for m in _STANDINS.finditer(folded) if m.start() and folded[m.start() - 1].isalpha()]
    out = [folded]
    for marks in ("!|", ""):
        said, at = [], 0
        for m in runs:
            said += [folded[at : m.start()], (core := m[0].rstrip(marks) if marks else m[0]).translate(SUBSTITUTES), m[0][len(core) :]]
            at = m.end()
        if runs and (text := "".join([*said, folded[at:]])) not in out:
            out.append(text)
    return out


def terms_of(folded: str) -> set[str]:
    """Lexicon candidates: word beginnings ("abcd*") and whole words ("abcd")."""
    out = set()
    for w in set(_WORD.findall(folded)):
        n = len(w)
        out.add(w)
        out.update(w[:k] + "*" for k in PREFIXES if k <= n)
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[tuple[str, str, bool]] = frozenset()  # (term, neighbouring word, the word stands before)
    bias: float = -2.0
    slopes: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @property
    def automaton(self) -> ahocorasick.Automaton | None:
        if not hasattr(self, "_automaton"):
            a = None
            if self.weights:
                a = ahocorasick.Automaton()
                by_text: dict[str, list[str]] = {}
                for t in self.weights:
                    by_text.setdefault(t.rstrip("*"), []).append(t)
                for w, ts in by_text.items():
                    a.add_word(w, (len(w), ts))
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def hits(self, folded: str) -> list[tuple[int, str]]:
        """(position, term): the heaviest term at each word start that holds one."""
        if not self.automaton:
            return []
        best: dict[int, str] = {}
        n = len(folded)
        for last, (size, ts) in self.automaton.iter(folded):
            at = last - size + 1
            if at and folded[at - 1].isalnum():
                continue
            whole = last + 1 == n or not folded[last + 1].isalnum()
            for t in ts:
                if (whole or t[-1] == "*") and (at not in best or self.weights[t] > self.weights[best[at]]):
                    best[at] = t
        return sorted(best.items())

    def features(self, folded: str) -> tuple[float, float, float]:
        """log(1 + weight), weight by the root of the number of words, largest weight."""
        texts = readings(folded)
        best = dict(self.hits(folded))
        for text in texts[1:]:
            for at, t in self.hits(text):
                if at not in best or self.weights[t] > self.weights[best[at]]:
                    best[at] = t
        excused = lambda at, t: self.exceptions and any((t, *c) in self.exceptions for x in texts for c in contexts(x, at))
        found = [t for at, t in sorted(best.items()) if not excused(at, t)]
        if not found:
            return 0.0, 0.0, 0.0
        w = [self.weights[t] for t in found]
        words = folded.count(" ") + folded.count("\n") + 1
        return math.log1p(sum(w)), sum(w) / math.sqrt(words), max(w)

    def score(self, text: str | None) -> float:
        z = self.bias + sum(a * b for a, b in zip(self.slopes, self.features(fold(text)), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def contexts(folded: str, at: int) -> list[tuple[str, bool]]:
    """The words before and after the word at ``at``, at most four other characters away, with True for before."""
    out = []
    if m := _GAP_BEFORE.search(folded, max(0, at - 4), at):
        start = m.start()
        while start and folded[start - 1].isalnum():
            start -= 1
        if start < m.start():
            out.append((folded[start : m.start()], True))
    if (m := _WORD.match(folded, at)) and (m := _WORD_AFTER.match(folded, m.end())):
        out.append((m[1], False))
    return out


def _tallied(sample: DataFrame, keys_of) -> DataFrame:
    """(term, n_toxic, n_clean): rows of ``sample`` (text, toxic) with each key, summed within a batch first."""

    def run(batches):
        for b in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                seen[toxic].update(keys_of(fold(text)))
            terms = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *(pa.array([seen[k][t] for t in terms], pa.int64()) for k in (1, 0))], names=["term", "n_toxic", "n_clean"]
            )

    rows = sample.select("text", "toxic").mapInArrow(run, "term string, n_toxic long, n_clean long")
    return rows.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n_toxic", "n_clean")))


def _g2(a: float, b: float, p: float):
    """Twice the log likelihood ratio of a of a + b rows against the share p, for columns."""
    n = a + b
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    return 2 * (part(a, n * p) + part(b, n * (1 - p)))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of labelled rows that aren't held out, at most about ``most`` by a hash of doc_id.

    Rows with a null id, label or text don't train; of several labels of a document or a text the largest counts, and
    texts count once, so that copies aren't taken for evidence.
    """
    use = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)")
    use = use.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    n = use.count()
    if n > most:
        use = use.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * most / n))
    use = use.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # About ``most`` pairs of numbers, so they can be sent to all executors.
    return docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").join(F.broadcast(use), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """A model from labelled documents. Without rows of both kinds, all scores are the share of toxic rows."""
    bounded_batches(docs.sparkSession)
    sample = materialise(training_rows(docs, labels, most), "toxicity-sample")
    n = dict(sample.groupBy("toxic").count().collect())
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        p = min(0.95, max(0.05, toxic / (toxic + clean))) if n else 0.05
        return Model(bias=math.log(p / (1 - p)))
    p = toxic / (toxic + clean)
    tallies = materialise(_tallied(sample, terms_of), "toxicity-terms")
    tried = tallies.where("n_toxic + n_clean >= 5").count()  # rarer terms can't pass
    bound = 2 + 2 * math.log(1 + tried)
    weight = F.log((F.col("n_toxic") + 0.5) / (toxic + 1)) - F.log((F.col("n_clean") + 0.5) / (clean + 1))
    found = (
        tallies.withColumns({"weight": weight, "g2": _g2(F.col("n_toxic"), F.col("n_clean"), p)})
        .where((F.col("weight") >= 1.5) & (F.col("g2") >= bound))
        .orderBy(F.desc("g2"), "term")
        .collect()
    )
    below: dict[str, int] = {}  # most toxic rows of a term that a beginning is part of
    for r in found:
        t = r["term"].rstrip("*")
        for k in range(min(PREFIXES), len(t) + (r["term"][-1] != "*")):
            below[t[:k] + "*"] = max(below.get(t[:k] + "*", 0), r["n_toxic"])
    found = [r for r in found if below.get(r["term"], 0) < 0.95 * r["n_toxic"]]  # the longer of two with the same rows
    weights: dict[str, float] = {}
    for r in sorted(found, key=lambda r: (len(r["term"].rstrip("*")), r["term"][-1] != "*", r["term"])):
        t = r["term"].rstrip("*")
        above = [weights[t[:k] + "*"] for k in range(min(PREFIXES), len(t) + 1) if t[:k] + "*" in weights]
        if not above or r["weight"] > max(above) + 0.5:
            weights[r["term"]] = r["weight"]
    model = Model(weights)
    if not weights:
        return Model(bias=math.log(p / (1 - p)))

    def phrases(folded: str) -> set[str]:
        return {"\t".join((t, w, "<" if before else ">")) for at, t in model.hits(folded) for w, before in contexts(folded, at)}

    excused = (
        _tallied(sample, phrases)
        .where((F.col("n_clean") >= 5) & (F.col("n_toxic") * (clean / toxic) <= 0.25 * F.col("n_clean")))
        .orderBy(F.desc("n_clean"), "term")
        .collect()
    )
    split = [r["term"].split("\t") for r in excused]
    model = Model(weights, frozenset((t, w, side == "<") for t, w, side in split))

    def measure(batches):
        for b in batches:
            rows = [model.features(fold(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(3))], names=["toxic", "a", "b", "c"])

    rows = sample.select("toxic", "text").mapInArrow(measure, "toxic int, a double, b double, c double").toPandas()  # four numbers for each sampled row
    x = rows[["a", "b", "c"]].to_numpy()
    bias, slopes = _logistic(x, rows["toxic"].to_numpy(float))
    return Model(weights, model.exceptions, bias, slopes)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, tuple[float, float, float]]:
    """Newton steps; slopes aren't negative, as more evidence mustn't lower a score."""
    use = [0, 1, 2]
    while True:
        a = np.column_stack([np.ones(len(x)), x[:, use]])
        w = np.zeros(a.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            pull = ridge * np.r_[0, w[1:]]
            step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), a.T @ (y - p) - pull)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        if (w[1:] >= 0).all():
            out = [0.0] * 3
            for k, v in zip(use, w[1:], strict=True):
                out[k] = float(v)
            return float(w[0]), tuple(out)
        use.pop(int(np.argmin(w[1:])))


@lru_cache(maxsize=1)
def _model(data: bytes) -> Model:
    import pickle

    return pickle.loads(data)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` with toxicity_score added; null and empty texts are scored by the curve's foot.

    A column of that name, in any case, is replaced. Repeated rows stay and score alike.
    """
    import pickle

    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "toxicity_score"))

    bounded_batches(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        m = _model(data.value)
        for b in batches:
            scores = pa.array([m.score(t) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, "toxicity_score"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("toxicity_score", T.DoubleType())]))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, with all their columns, repeated rows and ties included.

    Null and empty texts score by the curve's foot, far below, and stay; an empty frame stays empty.
    """
    import pickle

    bounded_batches(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        m = _model(data.value)
        for b in batches:
            yield b.filter(pa.array([m.score(t) < threshold for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each row of ``documents``; null and empty texts have the foot of the curve, repeated rows score alike, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return score_documents(docs, model).select(
        "doc_id",
        held.alias("held_out"),
        F.col("toxicity_score").alias("score"),
        (F.col("toxicity_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
