"""Near-duplicates by SetSketch registers, banding, a joint likelihood and exact verification.

1. Each document's set of word shingles is sketched: for each of ``REGISTERS`` hash functions the least
   exponential variate over the set, on an exponential scale of base ``BASE``, truncated to 16 bits.
   Registers of a union are the larger registers, and registers of two sets agree the oftener the more alike they are.
   Documents with one sequence of words are one node from here on.
2. Groups of ``ROWS`` registers are band values; nodes that share one meet. Each node is held against the least node (the
   pivot) of each of its band values: the likelihood of the pair's registers, given both sizes, says whether a
   similarity at the threshold is plausible. The most alike plausible pivot is then compared on full sets of shingles, and
   links that hold give first components. A node sends one set, whatever the size of its group.
3. Only nodes of different components can still add a link. Where such nodes meet, plausible pairs chain them into
   clusters, and in each cluster those of different components are compared on full sets, so that no link is lost.

Members of a group's largest component stay where they are and only the others travel to them, so a group of near copies
costs rows in proportion to its size; pairs that neither share a component nor a link are the only ones that are
all compared. Groups of any size are cut into blocks and streamed: no task holds a whole group, and tasks emit spanning
stars of their links, never all pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlint.llm.common import WordHash, bloom_of, bounded_batches, discard, hash_words, materialise, perhaps_in, raw_texts, table, window_hashes
from emberlint.llm.graph import Forest, components

SHINGLE = 5
PERCENT = 75  # of the union that two sets share at least
ROWS, BANDS = 4, 32
REGISTERS = ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Nodes that look up one pivot in one place.
STAR = 512
#: Members of a block of a band value or of a cluster, and shingles of a block of a cluster.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Rows that a task remembers to leave out repeated ones.
SEEN = 100_000
#: A pair is dropped unverified if the threshold is this much less likely (natural logarithm) than the best estimate: 5 deviations.
UNLIKELY = 12.5

_RNG = np.random.default_rng(20_240_607)
_MULTIPLY = (_RNG.integers(0, 1 << 32, REGISTERS, np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, REGISTERS, np.uint64).astype(np.uint32)


def shingle_set(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of every n words in a row; fewer words are one shingle, no words none."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(words, min(n, len(words))) + np.uint64(min(n, len(words))))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a set of hashes."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(least, (short[at : at + 1024, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    if not len(short):
        return np.zeros(REGISTERS, np.uint16)
    x = -np.log1p(-(least + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sketched sets."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(j, larger, smaller, n_a, n_b):
    """Of similarity ``j``, given how many registers of a are larger and smaller than b's, and the set sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    up, down = np.maximum(_p(np.maximum(u - v * j, 0)), 1e-12), np.maximum(_p(np.maximum(v - u * j, 0)), 1e-12)
    return larger * np.log(up) + smaller * np.log(down) + (REGISTERS - larger - smaller) * np.log(np.maximum(1 - up - down, 1e-12))


def plausible(larger, smaller, n_a, n_b, threshold: float = PERCENT / 100) -> np.ndarray:
    """For pairs: False where the similarity surely is below the threshold, by set sizes or by the likelihood ratio."""
    larger, smaller, n_a, n_b = (np.asarray(x, float) for x in (larger, smaller, n_a, n_b))
    low, high = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    ok = low >= threshold * high
    unsure = np.flatnonzero(ok & (larger + smaller > (1 - threshold) * REGISTERS))
    if len(unsure):
        args = [x[unsure] for x in (larger, smaller, n_a, n_b)]
        most = (low / high)[unsure]
        best = np.max([log_likelihood(np.minimum(j, most), *args) for j in np.linspace(0, 1, 51)], axis=0)
        there = np.max([log_likelihood(np.minimum(j, most), *args) for j in np.linspace(threshold, 1, 13)], axis=0)
        ok[unsure] = there >= best - UNLIKELY
    return ok


_SKETCHED = "doc_id long, crc long, node binary, n_shingles long, registers binary"


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, crc of the text, node, n_shingles, registers) of each document; node and registers are null without words."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        cache = WordHash()
        for b in batches:
            nodes, sizes, registers = [], [], []
            for raw in raw_texts(b.column("text")):
                words = raw.lower().split()
                found = shingle_set(hash_words(words, cache))
                sizes.append(len(found))
                nodes.append(node_of(words) if words else None)
                registers.append(sketch(found).tobytes() if words else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("crc"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(registers, pa.binary())],
                names=["doc_id", "crc", "node", "n_shingles", "registers"],
            )

    return docs.select(F.col("doc_id").cast("long"), checksum("text").alias("crc"), F.col("text").cast("string")).mapInArrow(run, _SKETCHED)


def checksum(text: str):
    """CRC-32 of a text column; null is as empty."""
    return F.crc32(F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8"))


def node_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _runs(batches, keys: list[str]):
    """(key, columns as a table) of neighbouring rows with equal ``keys``; a run that spans batches comes in several parts."""
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        new = np.ones(t.num_rows, bool)
        new[1:] = False
        cols = [t.column(k).to_pylist() if pa.types.is_binary(t.schema.field(k).type) else t.column(k).to_numpy() for k in keys]
        for x in cols:
            if isinstance(x, list):
                new[1:] |= np.fromiter((p != q for p, q in zip(x[1:], x, strict=False)), bool, len(x) - 1)
            else:
                new[1:] |= x[1:] != x[:-1]
        first = np.append(np.flatnonzero(new), t.num_rows).tolist()
        for s, e in zip(first[:-1], first[1:], strict=True):
            yield tuple(x[s] for x in cols), t.slice(s, e - s)


def _stars(forest: Forest) -> pa.RecordBatch:
    nodes, roots = forest.stars()
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(roots, pa.binary())], names=["a", "b"])


def _fixed(column: pa.ChunkedArray, dtype) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype).reshape(len(column), -1)


# --- step 2: one plausible pivot for each node ----------------------------------------------------------------------


def band_values(nodes: DataFrame) -> DataFrame:
    """(bucket, node): a row for each node and band."""
    at = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("registers", k * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    return nodes.select(F.explode(at).alias("bucket"), "node")


def meetings(nodes: DataFrame) -> DataFrame:
    """(bucket, least, size) of band values that several nodes share; ``least`` is the least hash among their names."""
    met = band_values(nodes).groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.xxhash64("node")).alias("least"))
    return met.where("size > 1")


def _scored(batches):
    """Pairs whose registers leave the threshold plausible, with the number of registers that differ."""
    for b in batches:
        mine, its = _fixed(b.column("registers"), np.uint16), _fixed(b.column("its_registers"), np.uint16)
        larger, smaller = (mine > its).sum(1), (mine < its).sum(1)
        ok = plausible(larger, smaller, b.column("n_shingles").to_numpy(), b.column("its_n").to_numpy())
        b = b.append_column("differ", pa.array((larger + smaller).astype(np.int32))).filter(pa.array(ok))
        yield b.select(["node", "pivot", "salt", "differ"])


def pivot_pairs(nodes: DataFrame, met: DataFrame) -> DataFrame:
    """(node, pivot, salt, differ): plausible pairs of a node and the least node of a band value that they share.

    At most one row for each node and band. A pivot of many nodes is looked up in several places (salts).
    """
    size_of = met.groupBy("least").agg(F.max("size").alias("size"))
    places = F.ceil(F.col("size") / STAR)
    known = nodes.select("node", "n_shingles", "registers")
    pivots = known.withColumn("least", F.xxhash64("node")).join(size_of, "least").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), places - 1)))
    pivots = pivots.select("least", "salt", F.col("node").alias("pivot"), F.col("n_shingles").alias("its_n"), F.col("registers").alias("its_registers"))
    pairs = band_values(nodes).join(met, "bucket").where(F.xxhash64("node") != F.col("least"))
    pairs = pairs.groupBy("node", "least").agg(F.max("size").alias("size")).withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), places))
    pairs = pairs.select("node", "least", "salt").join(known, "node").join(pivots, ["least", "salt"])
    fits = (100 * F.col("n_shingles") >= PERCENT * F.col("its_n")) & (100 * F.col("its_n") >= PERCENT * F.col("n_shingles"))
    pairs = pairs.where(fits).select("node", "pivot", "salt", "n_shingles", "its_n", "registers", "its_registers")
    return pairs.mapInArrow(_scored, "node binary, pivot binary, salt long, differ int")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def links_to_pivots(asked: DataFrame, ids: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): nodes and pivots of ``asked`` (node, pivot, salt) whose full sets hold; one row in, at most one out.

    A task reads a pivot's set and then streams its nodes past it, so it holds one set whatever the group's size.
    """
    own = asked.select(F.col("pivot").alias("node"), "pivot", "salt").distinct()
    placed = asked.select("node", "pivot", "salt", F.lit(1).alias("turn")).unionByName(own.withColumn("turn", F.lit(0))).join(ids, "node")
    placed = with_sets(placed, sets)

    def run(batches):
        held, its = None, None
        for (pivot, salt, turn), t in _runs(batches, ["pivot", "salt", "turn"]):
            raw = t.column("shingles").to_pylist()
            if turn == 0:
                held, its = (pivot, salt), np.frombuffer(raw[0], np.uint64)
                continue
            if held != (pivot, salt):
                raise ValueError("a pivot's set is missing")
            names, found = t.column("node").to_pylist(), set()
            for name, x in zip(names, (np.frombuffer(r, np.uint64) for r in raw), strict=True):
                both = common(x, its)
                if 100 * both >= percent * (len(x) + len(its) - both):
                    found.add(name)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([pivot] * len(found), pa.binary())], names=["a", "b"])

    order = ["pivot", "salt", "turn"]
    return placed.repartition("pivot", "salt").sortWithinPartitions(*order).select(*order, "node", "shingles").mapInArrow(run, "a binary, b binary")


# --- step 3: what pivots leave open ---------------------------------------------------------------------------------


def dealt(members: DataFrame, group: str, blocks) -> DataFrame:
    """Rows of ``members`` (group, node, label, ...) for an exact comparison of those with different labels: adds block, part, turn.

    The members of a group's most frequent label stay in one block each; the others stay in one and visit the rest, so
    every two members with different labels meet. Turn 0 is at home and of that label, 1 at home, 2 a visitor.
    Visitors are dealt over parts of some ``BLOCK`` each, and a block stands in all its group's parts; its own members
    meet each other in part 0. ``blocks`` gives the number of blocks from size, the group's rows.
    """
    by_label = members.groupBy(group, "label").agg(F.count("*").alias("n"))
    sums = by_label.groupBy(group).agg(F.sum("n").alias("size"), F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("most"))
    sums = sums.where("labels > 1").select(group, "size", F.col("most.label").alias("main"), (F.col("size") - F.col("most.n")).alias("others"))
    out = members.join(sums, group).withColumn("blocks", blocks)
    home = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks"))
    zero = F.lit(0).cast("long")
    everywhere = F.sequence(zero, F.col("blocks") - 1)
    out = out.withColumn("home", home).withColumn("block", F.explode(F.when(F.col("label") == F.col("main"), F.array("home")).otherwise(everywhere)))
    turn = F.when(F.col("block") != F.col("home"), 2).when(F.col("label") == F.col("main"), 0).otherwise(1)
    parts = F.when(F.col("blocks") > 1, F.ceil(F.col("others") / BLOCK)).otherwise(1).cast("long")
    its = F.when(F.col("turn") == 2, F.array(F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")))).otherwise(F.sequence(zero, F.col("parts") - 1))
    out = out.withColumn("turn", turn).withColumn("parts", parts).withColumn("part", F.explode(its))
    return out.drop("blocks", "parts", "home", "main", "size", "others")


def _blocks(batches, keys: list[str], columns: list[str]):
    """(home, rows) for groups of rows with equal ``keys``, sorted by these and ``visits``.

    Once a group's own members are all there they come as ``home`` with None, then with each part of its visitors.
    Both are dicts of ``columns``: arrays of numbers, lists of anything else.
    """

    def opened(t: pa.Table) -> dict:
        return {c: t.column(c).to_pylist() if pa.types.is_binary(t.schema.field(c).type) else t.column(c).to_numpy() for c in columns}

    def joined(parts: list[dict]) -> dict:
        if len(parts) == 1:
            return parts[0]
        return {c: [v for x in parts for v in x[c]] if isinstance(parts[0][c], list) else np.concatenate([x[c] for x in parts]) for c in columns}

    now, parts, home = None, [], None
    for b in batches:
        if not b.num_rows:
            continue
        cols = opened(pa.Table.from_batches([b]))
        visits = b.column("visits").to_numpy(zero_copy_only=False)
        key = [b.column(k).to_numpy() if not pa.types.is_binary(b.schema.field(k).type) else np.array(b.column(k).to_pylist(), object) for k in keys]
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for x in [*key, visits]:
            new[1:] |= x[1:] != x[:-1]
        first = np.append(np.flatnonzero(new), b.num_rows).tolist()
        for s, e in zip(first[:-1], first[1:], strict=True):
            at = tuple(x[s] for x in key)
            rows = {c: x[s:e] for c, x in cols.items()}
            if at != now:
                if parts and home is None:
                    yield joined(parts), None
                now, parts, home = at, [], None
            if not visits[s]:
                parts.append(rows)
            elif parts:
                if home is None:
                    home = joined(parts)
                    yield home, None
                yield home, rows
    if parts and home is None:
        yield joined(parts), None


#: Registers in which two sets at the threshold may differ, whatever their sizes; beyond, ``plausible`` says no.
MOST_DIFFERENT = 96
#: Pairs that are held against each other at one time.
PAIRS = 1 << 14


class Chain:
    """Chains nodes by plausible pairs; pairs are gathered and judged many at a time."""

    def __init__(self):
        self.forest, self.pending, self.n = Forest(), [], 0

    def meet(self, a: dict, b: dict, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs of rows ``i`` of ``a`` and ``j`` of ``b`` (node, label, n_shingles, registers as an array)."""
        x, y = a["n_shingles"][i], b["n_shingles"][j]
        ok = (a["label"][i] != b["label"][j]) & (100 * np.minimum(x, y) >= PERCENT * np.maximum(x, y))
        i, j = i[ok], j[ok]
        for k in range(0, len(i), PAIRS):
            ii, jj = i[k : k + PAIRS], j[k : k + PAIRS]
            x, y = a["registers"][ii], b["registers"][jj]
            larger, smaller = (x > y).sum(1), (x < y).sum(1)
            near = np.flatnonzero(larger + smaller <= MOST_DIFFERENT)
            if len(near):
                ii, jj = ii[near], jj[near]
                self.pending.append(([a["node"][q] for q in ii.tolist()], [b["node"][q] for q in jj.tolist()], larger[near], smaller[near], a["n_shingles"][ii], b["n_shingles"][jj]))
                self.n += len(near)
                if self.n >= PAIRS:
                    self.judge()

    def judge(self) -> None:
        if self.pending:
            cols = [np.concatenate([p[c] for p in self.pending]) for c in range(2, 6)]
            names = [[x for p in self.pending for x in p[c]] for c in range(2)]
            for k in np.flatnonzero(plausible(*cols)).tolist():
                self.forest.join(names[0][k], names[1][k])
        self.pending, self.n = [], 0


def plausible_links(nodes: DataFrame, met: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): nodes with different labels that share a band value and have a plausible pair, as stars.

    Pairs with a band value's pivot are left out: ``pivot_pairs`` had them.
    """
    members = band_values(nodes).join(met.where("size > 2"), "bucket").where(F.xxhash64("node") != F.col("least")).select("bucket", "node")
    members = members.join(labels, "node", "left").select("bucket", "node", F.xxhash64(F.coalesce("label", "node")).alias("label"))
    placed = dealt(members, "bucket", F.ceil(F.col("size") / BLOCK)).join(nodes.select("node", "n_shingles", "registers"), "node")

    def run(batches):
        chain = Chain()
        for home, rows in _blocks(batches, ["bucket", "block", "part"], ["part", "node", "label", "n_shingles", "registers"]):
            if rows is None:
                home["registers"] = np.frombuffer(b"".join(home["registers"]), np.uint16).reshape(-1, REGISTERS)
                if home["part"][0] == 0:
                    chain.meet(home, home, *np.triu_indices(len(home["node"]), 1))
                continue
            rows["registers"] = np.frombuffer(b"".join(rows["registers"]), np.uint16).reshape(-1, REGISTERS)
            for k in range(len(rows["node"])):
                chain.meet(rows, home, np.full(len(home["node"]), k), np.arange(len(home["node"])))
        chain.judge()
        yield _stars(chain.forest)

    fields = ["bucket", "block", "part", "visits", "node", "label", "n_shingles", "registers"]
    placed = placed.withColumn("visits", F.col("turn") == 2).repartition("bucket", "block", "part").sortWithinPartitions("bucket", "block", "part", "visits")
    return placed.select(*fields).mapInArrow(run, "a binary, b binary")


class Postings:
    """The sets of a block by element: how many elements a set shares with each of them is one look-up."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.values, self.first, self.many = np.unique(values[order], return_index=True, return_counts=True)

    def shared(self, x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.values, x)
        at[at == len(self.values)] = 0
        at = at[self.values[at] == x] if len(self.values) else at[:0]
        first, many = self.first[at], self.many[at]
        places = np.repeat(first - np.concatenate(([0], np.cumsum(many)[:-1])) if len(many) else first, many) + np.arange(many.sum())
        return np.bincount(self.owners[places], minlength=len(self.sizes))


def verified_links(clusters: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): labels that a link on full sets joins, as stars; from (cluster, node, doc_id, label, n_shingles) and full sets."""
    totals = clusters.groupBy("cluster").agg(F.sum("n_shingles").alias("total"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES), F.lit(1).cast("long"))
    placed = with_sets(dealt(clusters.join(totals, "cluster"), "cluster", blocks), sets)

    def run(batches):
        forest = Forest()
        for home, rows in _blocks(batches, ["cluster", "block", "part"], ["part", "node", "label", "turn", "shingles"]):
            if rows is None:
                index = Postings([np.frombuffer(x, np.uint64) for x in home["shingles"]])
                ask = np.flatnonzero((home["turn"] == 1) & (home["part"] == 0)).tolist()
                rows = home
            else:
                ask = range(len(rows["node"]))
            for i in ask:
                x, its = np.frombuffer(rows["shingles"][i], np.uint64), rows["label"][i]
                both = index.shared(x)
                for k in np.flatnonzero(100 * both >= percent * (index.sizes + len(x) - both)).tolist():
                    if home["label"][k] != its:
                        forest.join(its, home["label"][k])
        yield _stars(forest)

    fields = ["cluster", "block", "part", "visits", "turn", "node", "label", "shingles"]
    placed = placed.withColumn("visits", F.col("turn") == 2).repartition("cluster", "block", "part").sortWithinPartitions("cluster", "block", "part", "visits")
    return placed.select(*fields).mapInArrow(run, "a binary, b binary")


# --- all steps ------------------------------------------------------------------------------------------------------


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(its_id, its_node, shingles): full sets, at least of the nodes of ``wanted`` (node, doc_id); other texts are only read."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom_of(wanted.select("doc_id")))

    def run(batches):
        cache, bloom, seen = WordHash(), sent.value, set()
        for b in batches:
            b = b.filter(pa.array(bloom.holding(b.column("doc_id"))))
            ids, nodes, sets = [], [], []
            for i, raw in zip(b.column("doc_id").to_pylist(), raw_texts(b.column("text")), strict=True):
                words = raw.lower().split()
                if not words or (i, node := node_of(words)) in seen:  # rows that repeat id and text travel once a task
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add((i, node))
                ids.append(i)
                nodes.append(node)
                sets.append(shingle_set(hash_words(words, cache)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["its_id", "its_node", "shingles"])

    return docs.mapInArrow(run, "its_id long, its_node binary, shingles binary")


def with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` (node, doc_id, ...) with shingles. Repeated rows of a table may give a row more than once, which harms nothing."""
    same = (F.col("node") == F.col("its_node")) & F.col("doc_id").eqNullSafe(F.col("its_id"))
    return rows.join(sets, same).drop("its_id", "its_node")


def linked(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): components of the links among ``nodes`` (node, doc_id, n_shingles, registers) of ``docs``."""
    met = materialise(meetings(nodes), "shared-bands")
    pairs = materialise(pivot_pairs(nodes, met), "pivot-pairs")
    best = pairs.groupBy("node").agg(F.min(F.struct("differ", "pivot", "salt")).alias("best")).select("node", "best.pivot", "best.salt")
    best = materialise(best, "pivots")
    ids = nodes.select("node", "doc_id")
    wanted = best.select("node").unionByName(best.select(F.col("pivot").alias("node"))).distinct().join(ids, "node")
    links = materialise(links_to_pivots(best, ids, shingle_sets(docs, wanted)), "links")
    labels = materialise(components(links, "first-components").withColumnRenamed("root", "label"), "labels")

    left = pairs.select("node", "pivot").join(best.select("node", "pivot"), ["node", "pivot"], "left_anti")
    left = left.join(labels, "node", "left").withColumn("mine", F.coalesce("label", "node")).drop("label")
    left = left.join(labels.withColumnRenamed("node", "pivot"), "pivot", "left").where(F.col("mine") != F.coalesce("label", "pivot"))
    open_ = left.select(F.col("node").alias("a"), F.col("pivot").alias("b")).unionByName(plausible_links(nodes, met, labels))
    clusters = components(open_, "open").withColumnRenamed("root", "cluster")
    clusters = clusters.join(nodes.select("node", "doc_id", "n_shingles"), "node").join(labels, "node", "left")
    clusters = materialise(clusters.select("cluster", "node", "doc_id", "n_shingles", F.coalesce("label", "node").alias("label")), "clustered")
    more = materialise(verified_links(clusters, shingle_sets(docs, clusters)), "more-links")
    out = components(links.unionByName(more), "all-links")
    discard(met, pairs, best, links, labels, clusters, more)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, crc, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text); other columns are ignored.

    Null and empty texts have no shingles and are linked with nothing: their component is their own id. Rows
    with a null id get the least id of their component, or null if it has none, and are kept only then.
    Repeated rows are copies of each other. An empty frame gives an empty frame.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    drawn = materialise(sketches(docs), "sketches")
    nodes = drawn.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")
    )
    nodes = materialise(nodes, "nodes")
    named = linked(docs, nodes).join(nodes.select("node", "doc_id"), "node")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_linked = named.join(least, "root").select("node", "component_id")
    resolved = nodes.select("node", "doc_id").join(of_linked, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    resolved = materialise(resolved, "resolved")  # so that the join below, on nodes with many copies, can be split
    discard(nodes)
    out = drawn.select("doc_id", "crc", "n_shingles", "node").join(resolved, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "crc", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text and any others), one document of each group of near-duplicates.

    Rows that repeat id and text count once; other rows with the id of a document that stays are that document's.
    Only rows that may have to go are moved; the filter that tells them apart has a fixed size.
    """
    judged = materialise(near_duplicates(docs), "near-duplicates")
    gone = judged.where("not kept").select("doc_id", "crc")
    twice = judged.groupBy("doc_id", "crc").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", "crc")
    gone = materialise(gone.distinct(), "dropped")
    some = materialise(gone.unionByName(twice).distinct(), "dropped-or-repeated")
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_of(some.select("doc_id")))
    # The row travels as one column, so that no name of it can clash.
    keyed = perhaps_in(docs, bloom).select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), checksum("text").alias("crc"))
    out = keyed.alias("d").join(gone.alias("g"), F.expr("d.id <=> g.doc_id and d.crc = g.crc"), "left_anti").dropDuplicates(["id", "crc"])
    return out.select("row.*").unionByName(perhaps_in(docs, bloom, inverse=True))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all rows of ``documents``; null and empty texts stand alone, exactly 0.75 links, a null id is never the least, an empty table gives no rows."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).drop("crc")
