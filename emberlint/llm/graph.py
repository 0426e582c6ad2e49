"""Connected components of a large graph by minima and jumps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlint.llm.common import discard, materialise

#: Places that the links of one node are dealt to.
SALTS = 16
#: Links that one task joins on its own (some 50 MB as a forest); more are thinned by rounds first.
AT_ONCE = 1 << 17


class Forest:
    """Union-find over the nodes that one task sees; tells which links join what was apart."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def stars(self) -> tuple[list, list]:
        """Each node that isn't its tree's least, and the least."""
        nodes = list(self.up)
        return nodes, [self.root(x) for x in nodes]


def _kept(edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    """The distinct edges, written, with their number and a sum that tells whether they changed."""
    kept = materialise(edges.where("a != b").distinct(), label)
    return kept, tuple(kept.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _joined(batches):
    """Stars of the links (a, b), all of which this task sees."""
    forest = Forest()
    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            forest.join(x, y)
    nodes, roots = forest.stars()
    for k in range(0, len(nodes), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 10_000], b.schema.field(c).type) for x, c in ((nodes, "a"), (roots, "b"))], names=["a", "b"])


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) of every node with a link, root being its component's least node.

    ``edges`` has two columns a and b of one orderable type; links may repeat, point either way or be loops;
    rows with nulls are left out. In each round a node keeps its least neighbour below it and hands the others
    to that one, then all hang on their neighbour's neighbour; rounds follow the logarithm of the longest path.
    At most ``AT_ONCE`` links are left to one task instead, with the same result. Nothing but a count and a sum reaches the driver. A node has few links to lesser nodes, as tasks send
    stars; the links of a node that many hang on are dealt to several places.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null")
    now, before = _kept(now, label)
    while before[0] > AT_ONCE:
        least = now.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        pairs = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        last, (hung, _) = now, _kept(least.select(F.explode(pairs).alias("e")).select("e.a", "e.b"), label)
        # Only nodes that others hang on are looked up, and each in several places, as many may hang on one.
        above = hung.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "b").join(hung.select("b").distinct(), "b")
        above = above.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = hung.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
        now, after = _kept(salted.join(above, ["b", "salt"], "left").select("a", F.coalesce("m", "b").alias("b")), label)
        discard(last, hung)
        if after == before:
            break
        before = after
    if 0 < before[0] <= AT_ONCE:
        last, now = now, materialise(now.coalesce(1).mapInArrow(_joined, now.schema), label)
        discard(last)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
