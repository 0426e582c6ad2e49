"""A Merkle manifest of a dataset: one digest for all rows, and short proofs for each, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlint.functions.text import once
from emberlint.llm.common import materialise, table
from emberlint.llm.retention import crc32_sql

#: Children of a node, and levels that one block collapses: a block is an array of at most 16^3 digests.
FAN = 16
DEEP = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_SPLIT = "array<struct<before:string,after:string>>"


def digest(x: Column) -> Column:
    return F.sha2(x, 256)


def leaf_of(**values: Column) -> Column:
    """Digest of a row: each of ``FIELDS`` as its UTF-8 byte count, a colon and itself, or ``-`` for null."""
    said = [values.get(c, F.col(c)).cast("string") for c in FIELDS]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in said)))


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``place``, from 0, within its ``tree`` in order of the columns ``order``, and ``n``, the size of the tree.

    Rows are dealt by ranges of (tree, order) and written as sorted there, so a tree may take any number of tasks; a row's
    place is its place in the range and the number of the tree's rows in ranges before. Rows that are equal in all of these
    are told apart by where they were read, so that copies don't meet in one range.
    """
    dealt = nodes.withColumn("_read", F.monotonically_increasing_id())
    keys = ["tree", *order, "_read"]
    at = F.monotonically_increasing_id()  # the task in the high bits, the row in the low 33
    written = materialise(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read").withColumn("_at", at), "manifest-order")
    written = written.withColumn("_range", F.shiftright("_at", 33))
    parts = written.groupBy(F.col("tree").alias("_tree"), F.col("_range").alias("_of")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("_tree")
    upto = F.sum("_n").over(tree.orderBy("_of").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = parts.select("_tree", "_of", "_first", (upto - F.col("_n")).alias("_before"), F.sum("_n").over(tree).alias("n"))
    joined = written.join(parts, (F.col("tree") == F.col("_tree")) & (F.col("_range") == F.col("_of")))
    out = joined.withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_tree", "_of", "_first", "_before")
    return out


def _height(n: Column, fan: int) -> Column:
    """Levels above ``n`` leaves: the least h with fan^h >= n, counted in integers."""
    tops = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda h: F.pow(F.lit(fan), h).cast("decimal(38,0)"))
    return F.size(F.filter(tops, lambda top: top < n))


def _parents(nodes: Column, fan: int) -> Column:
    many = F.ceil(F.size(nodes) / fan).cast("int")
    return F.transform(F.sequence(F.lit(0), many - 1), lambda i: digest(F.array_join(F.slice(nodes, i * fan + 1, F.lit(fan)), "")))


def _steps(n: Column) -> Column:
    """[1, ..., n], empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _way_up(levels: Column, at: Column, fan: int) -> Column:
    """For the node at ``at`` of the lowest of ``levels``: what stands before and after it in its run, on each level but the top."""

    def split(nodes: Column, k: Column) -> Column:
        own = F.floor(at / F.pow(F.lit(float(fan)), k)).cast("int")
        first = own - own % fan
        before, after = F.slice(nodes, first + 1, own - first), F.slice(nodes, own + 2, fan - 1 - (own - first))
        return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), split)


def _blocks(nodes: DataFrame, fan: int, deep: int) -> DataFrame:
    """(tree, block, height, items, levels) from (tree, place, height, node, ...): arrays of at most fan^deep nodes, collapsed.

    ``items`` are the nodes' rows in order; ``levels`` are the digests of the block level by level, the last of which has one. ``height``
    counts the levels that the tree has above the nodes; a block collapses ``deep`` of them, or all that are left.
    """
    rest = [c for c in nodes.columns if c not in ("tree", "height")]
    width = fan**deep
    packed = nodes.groupBy("tree", F.floor(F.col("place") / width).alias("block"), "height").agg(F.array_sort(F.collect_list(F.struct("place", *(c for c in rest if c != "place")))).alias("items"))
    first = F.array(F.transform("items", lambda x: x["node"]))
    levels = F.aggregate(_steps(F.least(F.col("height"), F.lit(deep))), first, lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1), fan))))
    return packed.withColumn("levels", levels)


class Forest:
    """Trees of digests built from (tree, place, n, node, ...): blocks of the lowest level, and (tree, block, root, above) for each.

    ``above`` is the way from the block's root to the tree's root. Each round collapses three levels in arrays within
    rows and hands on one digest for 4096, so that rounds are few (three for 10^10 rows) and each is one shuffle by block.
    """

    def __init__(self, nodes: DataFrame, rounds: int, fan: int = FAN, deep: int = DEEP):
        self.fan, self.deep = fan, deep
        nodes = nodes.withColumn("height", _height(F.col("n"), fan)).drop("n")
        self.stages = []
        for _ in range(rounds):
            blocks = materialise(_blocks(nodes, fan, deep), "manifest-blocks")
            self.stages.append(blocks)
            nodes = blocks.select("tree", F.col("block").alias("place"), F.greatest(F.col("height") - deep, F.lit(0)).alias("height"), F.element_at("levels", -1)[0].alias("node"))
        self.roots = nodes.select("tree", F.col("node").alias("root"))

    @staticmethod
    def rounds_for(nodes: DataFrame, fan: int = FAN, deep: int = DEEP) -> int:
        most, rounds = nodes.agg(F.max("n")).first()[0] or 1, 1
        while fan ** (deep * rounds) < most:
            rounds += 1
        return rounds

    def tops(self, ends: DataFrame) -> DataFrame:
        """(tree, block, root, way) of the lowest blocks, given (tree, root, way): each tree's root and the way on from it, if any."""
        above = self.stages[-1].select("tree", "block").join(ends, "tree")
        for blocks in reversed(self.stages[1:]):
            met = blocks.join(above, ["tree", "block"])
            below = F.transform("items", lambda x, k: F.struct(x["place"].alias("block"), F.concat(_way_up(F.col("levels"), k, self.fan), "way").alias("way")))
            kept = [c for c in above.columns if c not in ("tree", "block", "way")]
            above = met.select("tree", *kept, F.inline(below))
        return above


def proofs(leaves: DataFrame, fan: int = FAN, deep: int = DEEP) -> DataFrame:
    """(tree, ..., subroot, root, proof_sha256, folded_root, verified) for (tree, node, given, ...) in order of doc_id, then of node.

    ``tree`` names a tree of its own for each of its values, whose roots, in order of the names, are the leaves of the tree on
    top. ``given`` is the leaf that is checked against the manifest, ``node`` the leaf that went into it.
    """
    at = placed(leaves, ["doc_id", "node"])
    low = Forest(at, Forest.rounds_for(at, fan, deep), fan, deep)
    subroots = placed(low.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node")), ["name"])
    high = Forest(subroots, Forest.rounds_for(subroots, fan, deep), fan, deep)
    none = F.array().cast(_SPLIT)
    top = high.tops(high.roots.withColumn("way", none))
    lowest = high.stages[0].join(top, ["tree", "block"])
    ends = lowest.select(
        "root",
        F.inline(F.transform("items", lambda x, k: F.struct(x["name"].alias("tree"), x["node"].alias("subroot"), F.concat(_way_up(F.col("levels"), k, fan), "way").alias("way")))),
    )
    met = low.stages[0].join(low.tops(ends), ["tree", "block"])

    def proved(x: Column, way: Column) -> Column:
        folded = F.aggregate(way, F.coalesce(x["given"], x["node"]), lambda node, s: digest(F.concat(s["before"], node, s["after"])))
        siblings = F.array_join(F.transform(way, lambda s: F.concat(s["before"], s["after"])), "")
        return F.struct(x["doc_id"].alias("doc_id"), x["node"].alias("leaf"), digest(siblings).alias("proof_sha256"), folded.alias("folded_root"))

    each = F.transform("items", lambda x, k: once(F.concat(_way_up(F.col("levels"), k, fan), "way"), lambda way: proved(x, way)))
    out = met.select("subroot", "root", F.inline(each))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def manifest(docs: DataFrame, tampered: Column | None = None, fan: int = FAN, deep: int = DEEP) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    A tree for each source, null a source of its own that comes first. Rows of a source stand in order of doc_id (null first), those of
    one doc_id in order of their leaves; repeated rows have equal leaves and are each a leaf of their own. Where ``tampered`` holds, the row
    is checked as it would be with its text in lower case. Any column may be null, texts may be empty or long; other columns
    are ignored. Without rows there is no root and the result is empty.
    """
    lowered = F.when(F.coalesce(tampered, F.lit(False)), leaf_of(text=lower_ascii(F.col("text").cast("string")))) if tampered is not None else F.lit(None).cast("string")
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"), "doc_id", leaf_of().alias("node"), lowered.alias("given"))
    # Written before they are ordered: finding ranges reads its input twice, which should be digests and not texts.
    return proofs(materialise(rows, "manifest-leaves"), fan, deep)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``, checked with a fifth of the rows altered; see ``manifest`` for nulls, ties, repeated rows and empty tables."""
    altered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return manifest(table(spark, sf_dir, "documents", *FIELDS), altered)



_FIELD = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"
_TEXTS = [c if c in ("source", "lang", "text") else f"CAST({c} AS VARCHAR)" for c in FIELDS]
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(text if c == "text" else c) for c in _TEXTS) + ")"


_UP = "list_transform(range(0, (len(nodes) + 15) // 16), lambda i: sha256(array_to_string(nodes[i * 16 + 1 : i * 16 + 16], '')))"
_WAY = "{'b': array_to_string(nodes[own - own % 16 + 1 : own], ''), 'a': array_to_string(nodes[own + 2 : own - own % 16 + 16], '')}"

OP13_SQL = f"""
WITH RECURSIVE o AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM (SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf_sql("text")} AS leaf,
    CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf_sql(_LOWERED)} END AS given FROM documents)
), up(tree, level, nodes) AS (
  SELECT tree, 0, list(leaf ORDER BY place) FROM o GROUP BY tree UNION ALL SELECT tree, level + 1, {_UP} FROM up WHERE len(nodes) > 1
), sub AS (SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM up WHERE len(nodes) = 1),
top(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY place) FROM sub UNION ALL SELECT level + 1, {_UP} FROM top WHERE len(nodes) > 1
), low AS (
  SELECT tree, place, list({_WAY} ORDER BY level) AS way
  FROM (SELECT o.tree, o.place, level, nodes, o.place // CAST(16 ** level AS BIGINT) AS own FROM o JOIN up ON o.tree = up.tree AND len(nodes) > 1) GROUP BY tree, place
), high AS (
  SELECT tree, list({_WAY} ORDER BY level) AS way
  FROM (SELECT sub.tree, level, nodes, sub.place // CAST(16 ** level AS BIGINT) AS own FROM sub JOIN top ON len(nodes) > 1) GROUP BY tree
), w AS (
  SELECT o.doc_id, o.leaf, o.given, sub.subroot, list_concat(coalesce(low.way, []), coalesce(high.way, [])) AS way
  FROM o JOIN sub ON o.tree = sub.tree LEFT JOIN low ON o.tree = low.tree AND o.place = low.place LEFT JOIN high ON o.tree = high.tree
), f AS (
  SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root, sha256(array_to_string(list_transform(way, lambda s: s.b || s.a), '')) AS proof_sha256,
    list_reduce(list_prepend({{'b': '', 'a': coalesce(given, leaf)}}, way), lambda n, s: {{'b': '', 'a': sha256(s.b || n.a || s.a)}}).a AS folded_root FROM w
)
SELECT *, folded_root = root AS verified FROM f
"""
