"""Best-fit packing of tokenised documents into sequences of a fixed length.

Packing depends on the documents' lengths alone, and a length is at most the sequence length C: the
instance is a histogram of at most C numbers, however many documents there are. The driver solves it on the
histogram: first the Martello-Toth dominance reduction fixes sets of documents that are provably as good as
any alternative, then best-fit decreasing packs the rest, both for whole classes of equal lengths at a time.
The solution is a list of intervals: the i-th piece of a length goes to that sequence, at that offset.
Executors number the pieces of each length (a counter within a task, then sums over tasks) and look up
their places.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlint.llm.common import bounded_batches, materialise
from emberlint.llm.tokens import default_tokenizer, encode

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, local_rank long"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document (doc_id, text): ids, then the end id, cut only if over ``capacity``.

    Null texts are empty: one piece with the end id. ``local_rank`` counts pieces of one length in one task;
    the frame must be written before its ranks are used, as a second run may deal tasks differently.
    """

    bounded_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        name, task = tokenizer or default_tokenizer(), TaskContext.get().partitionId()
        seen, end = np.zeros(capacity + 1, np.int64), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = memoryview(encode(text, name) + end)
                for k, at in enumerate(range(0, len(ids) >> 2, capacity)):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    n = len(piece) >> 2
                    rows.append((doc, k, at, n, zlib.crc32(piece), task, int(seen[n])))
                    seen[n] += 1
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def dominance_reduction(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Martello-Toth: take sets out of ``counts`` (length: how many) that dominate all others with their longest piece.

    Tried for each length j, longest first, with room r = capacity - j. A set {j, k}, k the longest piece that
    fits, dominates if k = r, or if every set of two or more pieces that fits in r sums to k at most, as then
    whatever else could stand beside j can change places with k. {j} alone dominates if nothing fits. The pair
    sums are checked exactly for pairs; where three pieces fit as well, only k = r is taken as proven.
    Returns (pattern, how many sequences); what is left in ``counts`` isn't dominated.
    """
    fixed: list[tuple[dict[int, int], int]] = []
    sizes = sorted(counts)
    for j in reversed(list(sizes)):
        while counts.get(j, 0) > 0:
            room = capacity - j
            at = bisect_left(sizes, room + 1) - 1
            while at >= 0 and (counts[sizes[at]] - (sizes[at] == j)) <= 0:
                at -= 1
            if at < 0:
                fixed.append(({j: 1}, counts[j]))
                counts[j] = 0
                break
            k = sizes[at]
            if k != room and not _pairs_fit_in(counts, sizes, j, room, k):
                break
            n = counts[j] // 2 if j == k else min(counts[j], counts[k])
            fixed.append(({j: 2} if j == k else {j: 1, k: 1}, n))
            counts[j] -= n
            counts[k] -= n
        if not counts.get(j):
            counts.pop(j, None)
            sizes.remove(j)
    for s in [s for s, n in counts.items() if not n]:
        del counts[s]
    return fixed


def _pairs_fit_in(counts: dict[int, int], sizes: list[int], j: int, room: int, k: int) -> bool:
    """True if any two or more pieces that fit in ``room`` together (beside one j) sum to ``k`` at most."""
    left = lambda s: counts[s] - (s == j)
    least = []
    for s in sizes:
        least += [s] * min(3 - len(least), max(0, left(s)))
        if len(least) == 3 or s > room:
            break
    if len(least) < 2 or least[0] + least[1] > room:
        return True
    if len(least) == 3 and sum(least) <= room:
        return False
    have = [s for s in sizes if s <= room and left(s) > 0]
    lo, hi = 0, len(have) - 1
    while lo <= hi:
        both = have[lo] + have[hi]
        if both > room or lo == hi and left(have[lo]) < 2:
            hi -= 1
        elif both > k:
            return False
        else:
            lo += 1
    return True


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing by classes: the longest pieces first, each into the fullest sequence that still has room."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)  # by room left
    rooms: list[int] = []

    def put(pattern: dict[int, int], n: int, room: int) -> None:
        if n:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append((pattern, n))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                each = capacity // s
                put({s: each}, n // each, capacity - each * s)
                put({s: n % each}, int(n % each > 0), capacity - (n % each) * s)
                break
            room = rooms[at]
            pattern, m = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
            each = room // s
            full = min(m, n // each)
            put(pattern | {s: each}, full, room - each * s)
            n -= full * each
            if full < m and n:  # fewer pieces are left than one more sequence would take
                put(pattern | {s: n}, 1, room - n * s)
                full, n = full + 1, 0
            put(pattern, m - full, room)
    return [x for some in open_.values() for x in some]


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length: rows (rank from, rank to, first sequence, pieces in a sequence, offset of the first).

    The number of rows follows the number of lengths (at most ``capacity``), not the number of documents.
    """
    left = dict(counts)
    patterns = dominance_reduction(left, capacity) + best_fit(left, capacity)
    rank, sequence, out = defaultdict(int), 0, defaultdict(list)
    for pattern, n in patterns:
        offset = 0
        for s in sorted(pattern, reverse=True):
            each = pattern[s]
            out[s].append((rank[s], rank[s] + each * n, sequence, each, offset))
            rank[s] += each * n
            offset += each * s
        assert offset <= capacity
        sequence += n
    assert all(rank[s] == counts[s] for s in counts)
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to written pieces. An empty frame stays empty.

    Pieces of equal length are interchangeable: the task that wrote them and their order in it settle which stands where; repeated rows are each placed.
    """
    spark = pieces.sparkSession
    counted = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = spark.sparkContext.broadcast(plan_packing(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def place(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length):
                here = np.flatnonzero(length == s)
                rows = plan.value[int(s)]
                row = rows[np.searchsorted(rows[:, 0], rank[here], side="right") - 1]
                k = rank[here] - row[:, 0]
                sequence[here] = row[:, 2] + k // row[:, 3]
                offset[here] = row[:, 4] + k % row[:, 3] * s
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start")), b.column("length").cast(pa.int64()), b.column("ids_crc32"), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return (
        pieces.join(firsts, ["length", "task"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local_rank")).alias("rank"))
        .mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts are the end id alone; rows with null or equal ids are documents of their own; an empty frame gives no rows.
    """
    return pack(materialise(cut_pieces(docs, capacity, tokenizer), "pieces"), capacity)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all rows of ``documents`` in their sequences; null and empty texts are one token, repeated rows are each packed, an empty table gives no rows."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
