"""Token counts as delta-maintained rollups.

A ledger is a folder of batches. A batch holds signed changes, already summed by (source, lang, version):
inserts count +1 document and +n tokens, deletes -1 and -n, revisions 0 and new - old. Totals are the sums over
all committed batches, so documents are never read again to maintain them. A batch is written beside the ledger's batches
and takes its name by one rename that fails if the name is taken: of several writers of one batch one commits, a retry of an
unfinished batch starts anew, a replay of a finished one does nothing, and readers see whole batches only. Compaction
keeps the names of the batches it merges, so replays do nothing after it either.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlint.llm.common import bounded_batches, discard, materialise, scratch, table
from emberlint.llm.tokens import encode

_MERGED = ".merged"

KEYS = ("source", "lang", "version")
DELTAS = "source string, lang string, version string, n_docs long, n_tokens long"
#: Versions that are counted by patterns, without a tokenizer: runs of characters that aren't ASCII white space; runs of
#: ASCII letters and digits and characters beyond ASCII.
PATTERNS = {"space-1": r"[^\x20\x09-\x0D]+", "alnum-1": r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"}
#: Versions that are counted by a tokenizer, named by its vocabulary file.
VOCABULARIES = ("word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken")


def count_tokens(text: str, version: str):
    """Tokens of a text column under a version of ``PATTERNS``; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(PATTERNS[version])).cast("long"), F.lit(0).cast("long"))


@lru_cache(maxsize=4)
def _counter(path: str):
    """Text to its number of tokens; names of special tokens in it are ordinary text."""
    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text)) if text else 0
    return lambda text: len(encode(text, path)) // 4


def with_token_counts(docs: DataFrame, versions: dict[str, str]) -> DataFrame:
    """(all columns of ``docs`` but text, and a long column for each of ``versions``): tokens of its vocabulary file's tokenizer.

    Null and empty texts have none. A column of a version's name is replaced.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "text" and c not in versions]
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(v, T.LongType()) for v in versions)])

    def run(batches):
        counters = [_counter(path) for path in versions.values()]
        for b in batches:
            texts = b.column("text").to_pylist()
            counts = [pa.array([count(t) for t in texts], pa.int64()) for count in counters]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *counts], names=[*kept, *versions])

    return docs.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class TokenLedger:
    """Rollup of token counts in ``path``, any folder that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        """Whether a batch, under its own name or merged by a compaction, is part of the ledger."""
        at, fs = self._hadoop(f"{self.path}/{batch}/_SUCCESS")
        return fs.exists(at) or batch in self.merged()

    def _names(self) -> list[str]:
        at, fs = self._hadoop(self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def merged(self) -> set[str]:
        """Ids of batches that this ledger's compacted batch holds."""
        names = [f"{self.path}/{x}" for x in self._names() if x.endswith(_MERGED)]
        return {r[0] for r in self.spark.read.schema("id string").json(names).collect()} if names else set()  # a row a batch

    def batches(self) -> list[str]:
        """Ids of committed batches that have a folder of their own."""
        out = []
        for x in self._names():
            at, fs = self._hadoop(f"{self.path}/{x}/_SUCCESS")
            if not x.endswith(_MERGED) and not x.startswith(("_", ".")) and fs.exists(at):
                out.append(x)
        return out

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add ``changes`` (source, lang, version, n_docs, n_tokens, signed) under an id; False if it was there already.

        A batch is known by its id: whatever a replay brings is not read. Rows may repeat and keys may be null (a group of
        their own); null numbers count as 0. An empty frame is a valid batch. Ids that end in ``.merged`` or begin with a
        dot or an underscore are refused.
        """
        if not batch or batch.startswith(("_", ".")) or batch.endswith(_MERGED):
            raise ValueError(f"not an id of a batch: {batch!r}")
        if self.committed(batch):
            return False
        zero = F.lit(0).cast("long")
        written = f"{self.path}/.{batch}-{uuid.uuid4().hex}"
        (
            changes.groupBy(*KEYS)
            .agg(*(F.coalesce(F.sum(F.col(c).cast("long")), zero).alias(c) for c in ("n_docs", "n_tokens")))
            .coalesce(1)  # a row for each source, language and version
            .write.parquet(written)
        )
        return self._named(written, batch)

    def _named(self, written: str, batch: str) -> bool:
        """Give a written folder its batch's name; False, and the folder goes, if another writer was first."""
        source, fs = self._hadoop(written)
        target, _ = self._hadoop(f"{self.path}/{batch}")
        marker, _ = self._hadoop(f"{self.path}/{batch}/_SUCCESS")
        if fs.exists(target) and not fs.exists(marker):  # left by a writer that died
            fs.delete(target, True)
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        gateway = self.spark.sparkContext._gateway
        plain = gateway.new_array(getattr(gateway.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(source, target, plain)
        except Py4JJavaError as failed:
            if "FileAlreadyExists" not in str(failed.java_exception) and not fs.exists(marker):
                raise
            fs.delete(source, True)
            return False
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all committed batches; groups without documents or tokens are left out."""
        names = self.batches()
        if not names:
            return self.spark.createDataFrame([], DELTAS)
        rows = self.spark.read.schema(DELTAS).parquet(*(f"{self.path}/{x}" for x in names))
        sums = rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("n_docs", "n_tokens")))
        return sums.where("n_docs != 0 or n_tokens != 0")

    def compact(self, batch: str) -> DataFrame:
        """Write the totals as one batch of a new ledger beside this one, for readers and writers to move to.

        The new ledger knows the ids it merged, those of former compactions too, and takes none of them again.
        """
        into = TokenLedger(self.spark, f"{self.path}-{batch}")
        ids = sorted({*self.batches(), *self.merged()})
        if not into.committed(batch):
            self.spark.createDataFrame([(x,) for x in ids], "id string").coalesce(1).write.mode("overwrite").json(f"{into.path}/{batch}{_MERGED}")
            into.commit(batch, self.totals())
        return into.totals()


def inserts(docs: DataFrame, version: str, tokens: str) -> DataFrame:
    """Changes for ``commit``: new documents count 1 and their tokens; null counts count as 0, repeated rows each."""
    return docs.select("source", "lang", F.lit(version).alias("version"), F.lit(1).alias("n_docs"), F.col(tokens).alias("n_tokens"))


def deletes(docs: DataFrame, version: str, tokens: str) -> DataFrame:
    """Changes for ``commit``: documents that go count -1 and minus their tokens; null counts count as 0, repeated rows each."""
    return docs.select("source", "lang", F.lit(version).alias("version"), F.lit(-1).alias("n_docs"), (-F.col(tokens)).alias("n_tokens"))


def revisions(docs: DataFrame, version: str, old: str, new: str) -> DataFrame:
    """Changes for ``commit``: documents counted anew count 0 and the difference; null counts count as 0, repeated rows each."""
    return docs.select("source", "lang", F.lit(version).alias("version"), F.lit(0).alias("n_docs"), (F.col(new) - F.col(old)).alias("n_tokens"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after five batches over all documents, by the tokenizers of ``VOCABULARIES``.

    Documents come in with a count guessed from ``n_chars``, are revised to the counted tokens, are inserted under
    a second version, and those labelled as of low quality are deleted; the second batch is delivered twice. Nulls in keys are
    groups of their own, null texts have no tokens, and empty tables give no rows.
    """
    import public_tokenizers

    one, two = VOCABULARIES
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    docs = docs.withColumn("guessed", F.coalesce(F.floor(F.col("n_chars") / 4).cast("long"), F.lit(0).cast("long"))).drop("n_chars")
    counted = materialise(with_token_counts(docs, {"one": public_tokenizers.path(one), "two": public_tokenizers.path(two)}), "counted")
    low = table(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 0").select("doc_id")
    gone = counted.join(low, "doc_id", "left_semi")
    ledger = TokenLedger(spark, scratch(spark, "ledger"))
    ledger.commit("0001-insert", inserts(counted, one, "guessed"))
    ledger.commit("0002-revise", revisions(counted, one, "guessed", "one"))
    ledger.commit("0003-insert", inserts(counted, two, "two"))
    ledger.commit("0002-revise", revisions(counted, one, "guessed", "one"))
    ledger.commit("0004-delete", deletes(gone, one, "one").unionByName(deletes(gone, two, "two")))
    discard(counted)
    return ledger.totals()
