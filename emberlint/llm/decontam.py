"""Benchmark decontamination with an FM-index for each training shard.

A shard is a few megabytes of neighbouring documents in a task. Its words become symbols of the benchmark's
vocabulary; stretches of words that the benchmark doesn't have can't be in an occurrence and only separate. The
shard's index is the Burrows-Wheeler transform of what is left, in a wavelet matrix with ranks, and
suffix positions sampled at regular places and at starts of stretches. All windows of the benchmark are
searched backwards at once; occurrences are located by walking to a sampled suffix; overlapping and
touching occurrences merge into removal spans. No documents are shuffled.

The benchmark is sent to executors in blocks of a checked size: one block, as a rule; with more, each
block passes over all documents in turn and adds to the spans.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlint.llm.common import bounded_batches, input_bytes, materialise, raw_texts, sliced, table

WINDOW = 10
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 16 << 20
#: Every so many positions of a stretch, its suffix position is kept.
SAMPLE_EVERY = 8

#: Lower-cases A-Z; every byte outside words becomes a space.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_BYTES).split()


class Phrases:
    """The windows of a block of items: their vocabulary, their words as symbols, and the items each window is in."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str | None]] = {}
        for item, raw in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(raw)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + window]), set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[list[str | None]]]] = {}
        for n in sorted({len(k) for k in found}):
            keys = [k for k in found if len(k) == n]
            self.by_length[n] = np.array(keys, np.int64).reshape(-1, n), [list(found[k]) for k in keys]
        self.shortest = min(self.by_length, default=0)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling; all suffixes must differ before the end of the text."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    order, step = np.argsort(rank, kind="stable"), 1
    while n and rank.max() < n:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:]
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        ahead = np.empty(n, np.int64)
        ahead[0] = 1
        ahead[1:] = key[order[1:]] != key[order[:-1]]
        rank[order] = np.cumsum(ahead)
        step *= 2
    return order


class FMIndex:
    """Index of stretches of symbols 1, 2, ...; a 0 ends each stretch."""

    def __init__(self, text: np.ndarray, sample_every: int = SAMPLE_EVERY):
        n = len(text)
        ends = np.flatnonzero(text == 0)
        unique = text + len(ends)
        unique[ends] = np.arange(len(ends))  # each end sorts differently, so no two suffixes are equal
        order = suffix_array(unique)
        bwt = text[order - 1] if n else text
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1))))
        self.levels = max(1, int(text.max()).bit_length()) if n else 1
        self.ones, self.zeros = [], []
        level = bwt
        for b in range(self.levels - 1, -1, -1):
            bit = (level >> b & 1).astype(bool)
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            level = np.concatenate((level[~bit], level[bit]))
        self.base = self._descend(np.arange(len(self.counts) - 1), np.zeros(len(self.counts) - 1, np.int64))
        self.bwt, self.n = bwt, n
        offset = np.arange(n) - np.concatenate(([-1], ends))[np.searchsorted(ends, np.arange(n))] - 1
        self.kept = (offset % sample_every == 0)[order]
        self.where = np.where(self.kept, order, -1)

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, b in enumerate(range(self.levels - 1, -1, -1)):
            one = self.ones[k][at]
            at = np.where(symbol >> b & 1, self.zeros[k] + one, at - one)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where suffixes before ``at`` go when ``symbol`` is put before them: counts plus the wavelet rank."""
        return self.counts[symbol] + self._descend(symbol, at) - self.base[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each row of ``phrases``; empty ranges for those that don't occur."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        known = len(self.counts) - 1
        for k in range(phrases.shape[1] - 1, -1, -1):
            hi = np.where(phrases[:, k] < known, hi, lo)
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            symbol = phrases[live, k]
            lo[live], hi[live] = self.step(symbol, lo[live]), self.step(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by walking back to a sampled one."""
        rows, walked, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            here = self.kept[rows[todo]]
            out[todo[here]] = self.where[rows[todo[here]]] + walked
            todo = todo[~here]
            rows[todo] = self.step(self.bwt[rows[todo]], rows[todo])
            walked += 1
        return out


def stretches(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of at least ``least`` non-zero symbols, each ended by a 0, and where each symbol of them was."""
    known = np.concatenate(([False], ids > 0, [False]))
    edge = np.flatnonzero(known[1:] != known[:-1])
    start, end = edge[::2], edge[1::2]
    long = end - start >= max(1, least)
    start, size = start[long], (end - start)[long] + 1
    at = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    text = ids[np.minimum(at, len(ids) - 1)] if len(ids) else ids
    text[np.cumsum(size) - 1] = 0
    return text, at


def shard_hits(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set]]:
    """For each text of a shard: words, merged spans of hit words, and items with occurring windows."""
    ids, n = [], np.zeros(len(texts), np.int64)
    get = phrases.vocabulary.get
    for k, raw in enumerate(texts):
        words = words_of(raw)
        n[k] = len(words)
        ids.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
        ids.append(np.zeros(1, np.int64))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    if not phrases.by_length or not len(texts):
        return n, spans, items
    flat = np.concatenate(ids)
    first = np.concatenate(([0], np.cumsum(n + 1)))  # of each text in ``flat``
    text, at = stretches(flat, phrases.shortest)
    if not len(text):
        return n, spans, items
    index = FMIndex(text)
    cover = np.zeros(len(flat) + 1, np.int64)
    for size, (windows, owners) in phrases.by_length.items():
        lo, hi = index.search(windows)
        live = np.flatnonzero(lo < hi)
        if not len(live):
            continue
        many = (hi - lo)[live]
        rows = np.repeat(lo[live] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        found, which = at[index.locate(rows)], np.repeat(live, many)
        np.add.at(cover, found, 1)
        np.add.at(cover, found + size, -1)
        doc = np.searchsorted(first, found, side="right") - 1
        for pair in np.unique(doc * len(windows) + which).tolist():
            items[pair // len(windows)].update(owners[pair % len(windows)])
    hit = np.concatenate(([False], np.cumsum(cover)[:-1] > 0, [False]))
    edge = np.flatnonzero(hit[1:] != hit[:-1])
    docs = np.searchsorted(first, edge[::2], side="right") - 1
    for d, s, e in zip(docs.tolist(), edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        spans[d].append((s - int(first[d]), e - int(first[d])))
    return n, spans, items


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ADDED = (T.StructField("leak_n_words", T.LongType()), T.StructField("leak_hit_spans", _SPANS), T.StructField("leak_hit_items", T.ArrayType(T.StringType())))
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, cut: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with leak_n_words, leak_hit_spans (in words, merged) and leak_hit_items (distinct ids, sorted as strings).

    Null texts have no words; benchmark rows without words have no windows; items without an id mark words but
    aren't listed. Columns of ``docs`` named like the added ones are replaced. With ``cut``, instead of adding columns,
    the spans are cut out of ``text``, and documents of which no word is left are dropped.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = input_bytes(items, "text")
    blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    docs = docs.drop(*(f.name for f in _ADDED))
    names, schema = docs.columns, T.StructType([*docs.schema.fields, *_ADDED])
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k) if blocks > 1 else items
        found = Phrases([(r["item_id"], r["text"].encode()) for r in part.toLocalIterator()], window)
        sent = spark.sparkContext.broadcast(found)

        def run(batches, sent=sent, first=k == 0, last=k + 1 == blocks):
            for b in batches:
                texts = raw_texts(b.column("text"))
                counts, spans, owners = [], [], []
                for lo, hi in sliced(texts):
                    n, s, o = shard_hits(texts[lo:hi], sent.value)
                    counts += n.tolist()
                    spans += s
                    owners += o
                if not first:
                    before = zip(b.column("leak_hit_spans").to_pylist(), b.column("leak_hit_items").to_pylist(), strict=True)
                    for j, (s, o) in enumerate(before):
                        spans[j] = merged(spans[j], [(x["start"], x["end"]) for x in s])
                        owners[j] |= set(o)
                if cut and last:
                    yield _cut(b.select(names), texts, spans)
                    continue
                added = [
                    pa.array(counts, pa.int64()),
                    pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _SPAN_TYPE),
                    pa.array([sorted(o - {None}) for o in owners], pa.list_(pa.string())),
                ]
                old = [b.column(c) for c in b.schema.names if first or c not in ("leak_n_words", "leak_hit_spans", "leak_hit_items")]
                yield pa.RecordBatch.from_arrays([*old, *added], names=[f.name for f in schema.fields])

        docs = docs.mapInArrow(run, T.StructType(schema.fields[: len(names)]) if cut and k + 1 == blocks else schema)
        if k + 1 < blocks:
            docs = materialise(docs, "decontaminated")
    return docs


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words in ``spans`` and what stands between them."""
    raw, out, at = text.encode(), [], 0
    borders = [m.span() for m in _WORD.finditer(raw)] if spans else []
    for s, e in spans:
        out.append(raw[at : borders[s][0]])
        at = borders[e - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def _cut(batch: pa.RecordBatch, texts: list[bytes], spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    left = [cut_words(t.decode(), s) if s else None for t, s in zip(texts, spans, strict=True)]
    k = batch.schema.get_field_index("text")
    old = batch.column(k).to_pylist()
    batch = batch.set_column(k, "text", pa.array([o if x is None else x for o, x in zip(old, left, strict=True)], pa.string()))
    return batch.filter(pa.array([x is None or bool(words_of(x.encode())) for x in left], pa.bool_()))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with leaked spans cut out of ``text``; documents of which no word is left are dropped, clean ones stay as they are.

    Null and empty texts are clean; repeated rows are cut alike; an empty benchmark leaves all as it is.
    """
    return find_leaks(docs, benchmark, cut=True)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of each row of ``documents``; null and empty texts have none, repeated rows count alike, an empty table gives no rows."""
    found = find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    hit = F.aggregate("leak_hit_spans", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))
    return found.select(
        "doc_id",
        F.col("leak_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("leak_hit_items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("leak_hit_items", ","), "UTF-8"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
