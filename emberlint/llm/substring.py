"""Removal of repeated windows of words, found by recompression.

Rounds of recompression cut each text into blocks whose borders depend on nearby words only: first runs of one
word are named, then, round by round, pairs of neighbouring symbols of which the left is of one class and
the right of the other. A name is a fingerprint of what it stands for, so all tasks give equal strings
equal names without talking. Each block carries the stretch of words that its existence depends on (its reach), and
a name for itself among the symbols of that stretch; a copy of the stretch anywhere holds the same block by the same name.

1. Blocks whose reach fits in a window are anchors, and windows without an anchor are anchors themselves. Spark brings
   equal names of anchors together; names that occur once in the corpus rule out every window around them.
2. Windows around shared names are compared across the corpus by a second hash of all their words, which rests on other
   bits of the words' hashes than names do: all but the first occurrence of a window go.
3. Words covered by such windows are removed.

Between rounds, keys travel packed in arrays, a row for each task's slice and hash range, and keys that a slice
holds several times travel once.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlint.llm.common import CACHE_WORDS, bloom_of, bounded_batches, input_bytes, materialise, mix, perhaps_in, raw_texts, table

WINDOW = 20
ROUNDS = 4

_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_FAR = 1 << 40


class Words(dict):
    """Word (bytes) to its place in ``named`` and ``compared``, the two halves of a 128-bit hash, remembered."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.named, self.compared = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        both = xxhash.xxh3_128_intdigest(word)
        self.named.append(both >> 64)
        self.compared.append(both & 0xFFFFFFFFFFFFFFFF)
        self[word] = out = len(self.named) - 1
        return out

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of each word; a full memory is emptied between texts."""
        if len(self) >= CACHE_WORDS:
            self.forget()
        if not words:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.frombuffer(self.named, np.uint64)[at], np.frombuffer(self.compared, np.uint64)[at]


def _inverse(b: np.uint64) -> np.uint64:
    return np.uint64(pow(int(b), -1, 1 << 64))


class Rolling:
    """Hashes of any stretch of an array of word hashes."""

    def __init__(self, words: np.ndarray, base: np.uint64):
        n = len(words)
        up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64))))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:n])))
        self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _inverse(base), np.uint64))))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def recompress(words: np.ndarray, ends: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, name) of the blocks of ``words``, texts one after another, each ending before a place in ``ends``.

    From and to are a block's reach; one that depends on where its text begins or ends reaches beyond it, by far. The
    name is made of the block's symbol and, round by round, of the neighbours' names that decided its borders, so
    it is a matter of the words within the reach only; a bare symbol would make anchors of the commonest words.
    """
    n = len(words)
    # A border stands between texts, and before the first: it never joins, and what depends on it has no copy.
    first = np.concatenate(([0], ends[:-1])) if len(ends) else np.empty(0, np.int64)
    at = np.arange(n) + np.repeat(np.arange(len(ends)), ends - first) + 1
    symbol = np.zeros(n + len(ends) + 1, np.uint64)
    lo, hi = np.full(len(symbol), -_FAR), np.full(len(symbol), _FAR)
    border = np.ones(len(symbol), bool)
    symbol[at], border[at] = words, False
    lo[at], hi[at] = np.arange(n), np.arange(n) + 1

    # Runs of one symbol; that a run ends is known by its neighbours.
    same = (symbol[1:] == symbol[:-1]) & ~border[1:] & ~border[:-1]
    start = np.flatnonzero(np.concatenate(([True], ~same)))
    many = np.diff(np.append(start, len(symbol)))
    before, after = np.maximum(start - 1, 0), np.minimum(start + many, len(symbol) - 1)
    left, right = lo[before], hi[after]
    edge = np.column_stack([symbol[before], symbol[after]])
    symbol, border = symbol[start], border[start]
    symbol = np.where(many > 1, mix(symbol * _B2 + many.astype(np.uint64)), symbol)
    lo, hi = np.where(border, -_FAR, left), np.where(border, _FAR, right)
    name = symbol.copy()  # among the words beside the run, which the reach takes in
    name[1:-1] = mix((edge[1:-1, 0] * _B1 + symbol[1:-1]) * _B2 + edge[1:-1, 1])

    for k in range(rounds):
        right_class = (mix(symbol + np.uint64((k + 1) * int(_B1) % (1 << 64))) >> np.uint64(63)).astype(bool)
        joins = ~right_class[:-1] & right_class[1:] & ~border[:-1] & ~border[1:]
        # What stays alone knows so from its right neighbour if it is of the left class, else from its left one.
        other = np.clip(np.arange(len(symbol)) + np.where(right_class, -1, 1), 0, len(symbol) - 1)
        lo, hi = np.minimum(lo, lo[other]), np.maximum(hi, hi[other])
        name = mix(name * _B1 + mix(name[other] * _B2 + right_class))
        taken = np.concatenate(([False], joins))
        joined = np.concatenate((joins, [False]))
        i = np.flatnonzero(joined)
        symbol[i] = mix(symbol[i] * _B1 + symbol[i + 1])
        name[i] = mix((name[i] * _B2 + name[i + 1]) * _B1 + symbol[i])
        symbol, name, border, lo, hi = (x[~taken] for x in (symbol, name, border, lo, hi))
    return lo[~border], hi[~border], name[~border]


def segments(named: np.ndarray, compared: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, n, key, stretch): neighbouring windows that share an anchor, the anchor's name, the hash of all their words.

    ``named`` and ``compared`` are two hashes of each word: names come from the one, stretches from the other. A
    window's anchor is the one of least name in it, the leftmost of equal ones; so equal windows have equal keys, and
    no two windows of one segment are equal. A window without anchors is a segment of its own, its hash the key.
    """
    n = len(named)
    inside = np.zeros(n, bool)  # where a window starts that doesn't leave its text
    first = np.concatenate(([0], ends[:-1])) if len(ends) else np.empty(0, np.int64)
    room = np.repeat(ends, ends - first) - np.arange(n)
    inside[:] = room >= window
    if not inside.any():
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    lo, hi, key = recompress(named, ends)
    fits = (hi - lo <= window) & (lo >= 0)
    lo, hi, key = lo[fits], hi[fits], key[fits]
    one, two = Rolling(named, _B1), Rolling(compared, _B2)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    best, left = np.full(n, most), np.full(n, _FAR)
    reach = hi - lo
    for d in range(window - int(reach.min()) + 1 if len(reach) else 0):
        sel = np.flatnonzero((reach <= window - d) & (lo >= d))
        np.minimum.at(best, lo[sel] - d, key[sel])
    for d in range(window - int(reach.min()) + 1 if len(reach) else 0):
        sel = np.flatnonzero((reach <= window - d) & (lo >= d))
        sel = sel[best[lo[sel] - d] == key[sel]]
        np.minimum.at(left, lo[sel] - d, lo[sel])
    p = np.flatnonzero(inside)
    best, left = best[p], left[p]
    alone = left == _FAR
    best[alone] = one.of(p[alone], p[alone] + window)
    left[alone] = -1 - p[alone]
    new = np.ones(len(p), bool)
    new[1:] = (left[1:] != left[:-1]) | (p[1:] != p[:-1] + 1)
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(p)))
    start = p[at]
    return start, many, best[at], two.of(start, start + many + window - 1)


# --- distributed comparison -------------------------------------------------------------------------------------

#: Bytes of text that a task cuts into segments at one time; it holds some twenty numbers a word meanwhile.
SLICE_BYTES = 2 << 20
#: Bytes of text for each range of hashes that is compared at one time.
RANGE_BYTES = 8 << 20
#: Partitions of a shuffle by ranges of hashes; beyond, a task takes several ranges, one after another.
MOST_PARTITIONS = 20_000
_SENT = "kind int, bucket int, keys binary, stretches binary, starts binary, counts binary, docs binary"
_FOUND = "doc_id long, crc long, mixed boolean, ranges binary"
_NONE = np.iinfo(np.int64).min  # stands for a null doc_id, which sorts first


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    cols = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in _SENT.split(", ")])


def _sent(start, many, key, stretch, ids, crcs, first, buckets: int):
    """Rows for a slice: of equal stretches all but the earliest are decided here, the earliest go to their hash ranges.

    ``ids``, ``crcs`` and ``first`` (place of the first word) are the slice's texts, in ascending order of (id, crc).
    """
    order = np.lexsort((start, stretch, key))
    again = np.zeros(len(order), bool)
    k, s = key[order], stretch[order]
    again[1:] = (k[1:] == k[:-1]) & (s[1:] == s[:-1])
    decided = np.zeros(len(start), bool)
    decided[order[again]] = True
    to = ((key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    rows = []
    for kind, bucket, sel in [(1, int(crcs[0]) % buckets if len(crcs) else 0, np.flatnonzero(decided))] + [
        (0, int(b), part) for b, part in _by(to, np.flatnonzero(~decided))
    ]:
        if not len(sel):
            continue
        doc = np.searchsorted(first, start[sel], side="right") - 1
        used, doc = np.unique(doc, return_inverse=True)
        new = np.flatnonzero(np.diff(doc, prepend=-1))
        table = b"".join([np.diff(ids[used], prepend=0).tobytes(), crcs[used].astype(np.uint32).tobytes(), np.diff(np.append(new, len(sel))).astype(np.uint32).tobytes()])
        within = start[sel] - first[used][doc]
        gaps = np.diff(within, prepend=0).astype(np.int32)
        rows.append(
            (
                kind,
                bucket,
                b"" if kind else key[sel].tobytes(),
                b"" if kind else stretch[sel].tobytes(),
                _packed(gaps.astype("<i4").view(np.uint8).reshape(-1, 4).T.copy()),  # high bytes together
                many[sel].astype(np.uint8).tobytes(),
                zlib.compress(table, 1),
            )
        )
    return _table(rows)


def _by(group: np.ndarray, sel: np.ndarray):
    order = sel[np.argsort(group[sel], kind="stable")]
    at = np.flatnonzero(np.diff(group[order], prepend=-1))
    for s, e in zip(at, np.append(at[1:], len(order))[: len(at)], strict=True):
        yield group[order[s]], order[s:e]


def _opened(row: dict) -> tuple[np.ndarray, ...]:
    """(key, stretch, doc_id, crc, start, n) of a sent row."""
    many = np.frombuffer(row["counts"], np.uint8).astype(np.int64)
    raw = np.frombuffer(zlib.decompress(row["starts"]), np.uint8).reshape(4, -1)
    start = np.cumsum(raw.T.copy().view("<i4").ravel(), dtype=np.int64)
    table = zlib.decompress(row["docs"])
    d = len(table) // 16
    times = np.frombuffer(table, np.uint32, d, 12 * d)
    ids = np.repeat(np.cumsum(np.frombuffer(table, np.int64, d)), times)
    crcs = np.repeat(np.frombuffer(table, np.uint32, d, 8 * d).astype(np.int64), times)
    key, stretch = (np.frombuffer(row[c], np.uint64) for c in ("keys", "stretches"))
    return key, stretch, ids, crcs, start, many


def _found(ids, crcs, start, many, mixed: bool) -> pa.RecordBatch:
    """A row for each document: its ranges (first window, windows) as pairs of uint32."""
    order = np.lexsort((start, crcs, ids))
    ids, crcs = ids[order], crcs[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (crcs[1:] != crcs[:-1])
    at = np.flatnonzero(new)
    raw = np.column_stack([start[order], many[order]]).astype(np.uint32).tobytes()
    offsets = np.append(at, len(ids)).astype(np.int32) * 8
    ranges = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
    doc = pa.array(ids[at], mask=ids[at] == _NONE)
    return pa.RecordBatch.from_arrays([doc, pa.array(crcs[at]), pa.array(np.full(len(at), mixed)), ranges], names=["doc_id", "crc", "mixed", "ranges"])


def _compare(batches):
    """Of equal (key, stretch), all but the earliest are found; the earliest of keys with several stretches are mixed."""

    def judged(rows):
        cols = [np.concatenate(c) for c in zip(*rows, strict=True)]
        order = np.argsort(cols[0], kind="stable")
        k = cols[0][order]
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        order = order[same[1:] | same[:-1]]
        if not len(order):
            return
        key, stretch, ids, crcs, start, many = (c[order] for c in cols)
        order = np.lexsort((start, crcs, ids, stretch, key))
        key, stretch, ids, crcs, start, many = (c[order] for c in (key, stretch, ids, crcs, start, many))
        like = (key[1:] == key[:-1]) & (stretch[1:] == stretch[:-1])
        # A repeated row (one id and one text) has no earlier copy in its twin: both keep or lose the same words.
        twin = like & (ids[1:] == ids[:-1]) & (crcs[1:] == crcs[:-1]) & (start[1:] == start[:-1])
        later = np.concatenate(([False], like))
        lead = np.flatnonzero(~later)
        out = later.copy()
        if twin.any():
            group = np.cumsum(~later) - 1
            out &= ~((ids == ids[lead][group]) & (crcs == crcs[lead][group]) & (start == start[lead][group]))
        if out.any():
            yield _found(ids[out], crcs[out], start[out], many[out], False)
        heads = key[lead]
        kinds = np.zeros(len(heads) + 1, bool)
        kinds[1:-1] = heads[1:] == heads[:-1]
        mixed = lead[kinds[1:] | kinds[:-1]]
        if len(mixed):
            yield _found(ids[mixed], crcs[mixed], start[mixed], many[mixed], True)

    bucket, rows = None, []
    for b in batches:
        for row in b.to_pylist():
            if row["kind"]:
                yield _found(*_opened(row)[2:], False)
                continue
            if row["bucket"] != bucket and rows:
                yield from judged(rows)
                rows = []
            bucket = row["bucket"]
            rows.append(_opened(row))
    if rows:
        yield from judged(rows)


def _dealt(sent: DataFrame, buckets: int) -> DataFrame:
    n = min(buckets, MOST_PARTITIONS)  # ranges are numbered, so they are dealt by number: no task gets several by chance
    return sent.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("bucket").mapInArrow(_compare, _FOUND)


def _slices(batches, *more: str):
    """Texts of some megabytes at a time: (ids, crcs, raws, more columns), in ascending order of (id, crc)."""
    rows, size = [], 0
    for b in batches:
        ids = [_NONE if x is None else x for x in b.column("doc_id").to_pylist()]
        for row in zip(ids, b.column("crc").to_pylist(), raw_texts(b.column("text")), *(b.column(c).to_pylist() for c in more), strict=True):
            if rows and size + len(row[2]) > SLICE_BYTES:
                yield list(zip(*sorted(rows, key=lambda r: r[:2]), strict=True))
                rows, size = [], 0
            rows.append(row)
            size += len(row[2])
    if rows:
        yield list(zip(*sorted(rows, key=lambda r: r[:2]), strict=True))


def _hashed(raws, cache: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    named, compared = zip(*(cache.of(raw.split()) for raw in raws), strict=True)
    return np.concatenate(named), np.concatenate(compared), np.cumsum([len(h) for h in named])


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, crc, ranges) of ``docs`` (doc_id, crc, text): windows that also start earlier, as packed pairs (first, how many)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = max(64, -(-input_bytes(docs, "text") // RANGE_BYTES))

    def cut(batches):
        cache = Words()
        for ids, crcs, raws in _slices(batches):
            named, compared, ends = _hashed(raws, cache)
            start, many, key, stretch = segments(named, compared, ends, window)
            first = np.concatenate(([0], ends[:-1]))
            yield _once(_sent, start, many, key, stretch, ids, crcs, first, buckets)

    found = materialise(_dealt(docs.mapInArrow(cut, _SENT), buckets), "repeats")
    mixed = found.where("mixed").groupBy("doc_id", "crc").agg(F.collect_list("ranges").alias("ranges"))
    mixed = materialise(mixed, "mixed")
    some = perhaps_in(docs, spark.sparkContext.broadcast(bloom_of(mixed.select("doc_id")))).alias("d")
    same = F.expr("d.doc_id <=> m.doc_id and d.crc = m.crc")
    asked = some.join(mixed.alias("m"), same).select("d.doc_id", "d.crc", "d.text", "m.ranges")

    def windows(batches):
        cache = Words()
        for ids, crcs, raws, ranges in _slices(batches, "ranges"):
            named, compared, ends = _hashed(raws, cache)
            first = np.concatenate(([0], ends[:-1]))
            at = []
            for f, parts in zip(first, ranges, strict=True):
                s, n = np.frombuffer(b"".join(parts), np.uint32).reshape(-1, 2).astype(np.int64).T
                at.append(np.unique(f + np.repeat(s - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())))
            at = np.concatenate(at)
            key, stretch = (Rolling(*x).of(at, at + window) for x in ((named, _B1), (compared, _B2)))
            yield _once(_sent, at, np.ones(len(at), np.int64), key, stretch, ids, crcs, first, buckets)

    more = materialise(_dealt(asked.mapInArrow(windows, _SENT), buckets).where("not mixed"), "repeats")
    both = found.where("not mixed").unionByName(more)
    return both.groupBy("doc_id", "crc").agg(F.collect_list("ranges").alias("ranges"))


def _once(send, start, many, key, stretch, ids, crcs, first, buckets):
    """Rows of a slice; of rows with one id and one text only the first speaks, its twins have the same ranges."""
    ids, crcs = np.array(ids, np.int64), np.array(crcs, np.int64)
    twin = np.zeros(len(ids), bool)
    twin[1:] = (ids[1:] == ids[:-1]) & (crcs[1:] == crcs[:-1])
    if twin.any():
        doc = np.searchsorted(first, start, side="right") - 1
        keep = ~twin[doc]
        start, many, key, stretch = start[keep], many[keep], key[keep], stretch[keep]
    return send(start, many, key, stretch, ids, crcs, first, buckets)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept binary) for every row of ``docs`` (doc_id, text): kept words joined by one space.

    Of equal windows the first in order of (doc_id, start) stays; a null doc_id comes before all others; texts that
    share a doc_id are ordered by the checksum of their texts; rows that repeat id and text lose the same
    words. Null texts have no words; texts with fewer words than a window lose none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("crc", F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")))).select("doc_id", "crc", "text")
    ranges = materialise(repeated_ranges(docs, window), "repeated-ranges")
    fields = "doc_id long, n_words long, n_removed long, kept binary"
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_of(ranges.select("doc_id")))

    def untouched(batches):  # one Python stage that filters and cuts: two would hold twice the workers
        return cut(b.filter(pa.array(~bloom.value.holding(b.column("doc_id")))) for b in batches)

    def cut(batches):
        for b in batches:
            found = b.column("ranges").to_pylist() if "ranges" in b.schema.names else [None] * b.num_rows
            total, removed, kept = [], [], []
            for raw, parts in zip(raw_texts(b.column("text")), found, strict=True):
                words = raw.split()
                total.append(len(words))
                if parts:
                    s, n = np.frombuffer(b"".join(parts), np.uint32).reshape(-1, 2).astype(np.int64).T
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + n + window - 1, -1)
                    out = np.cumsum(edge)[:-1] > 0
                    words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"]
            )

    same = F.expr("d.doc_id <=> r.doc_id and d.crc = r.crc")
    hit = perhaps_in(docs, bloom).alias("d").join(ranges.alias("r"), same, "left").select("d.doc_id", "d.text", "r.ranges")
    return hit.mapInArrow(cut, fields).unionByName(docs.mapInArrow(untouched, fields))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept words of each row of ``documents``; null and empty texts have none, of equal windows the first stays (see ``remove_repeats`` for equal and null ids)."""
    cut = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
