"""Token ids in Parquet: encoding, the file format, selective reads.

Files are Spark Parquet tables with the columns

    doc_id, part (number of the writing task), local_start (ids before the document in its part),
    n_tokens, token_ids array<int>

Ids are dictionary-encoded (a dictionary of a 16-bit vocabulary fits its page), the number columns
delta-encoded (Parquet version 2 pages), row groups and pages have set sizes and page indexes are written,
so readers can take single columns, single documents or ranges of documents.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlint.llm.common import bounded_batches, scratch

END_ID = 2
#: Words whose ids a worker remembers (about 200 bytes each); a full cache is emptied and fills again.
CACHE_WORDS = 400_000
FORMAT = "doc_id long, part int, local_start long, n_tokens int, token_ids array<int>"
#: Writer options: sizes in bytes and rows.
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#token_ids.list.element": "true",
}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words that need neither normalisation nor case rules beyond one letter at a time: printable ASCII and Latin letters.
_PLAIN = re.compile(r"[!-~\xa1-\xac\xae-\u012f\u0131-\u024f]+")

#: In lower-case Latin-1 text: runs of letters, and what begins with something else up to the next space.
_RUNS = re.compile(r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[^ \na-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff][^ \n]*").findall


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Ids(dict):
    """Word to its ids as little-endian uint32 bytes.

    Plain words are lower-cased and cut by the tokenizer's own pattern, and each piece goes to the library's model
    once; all other words go through the library's whole pipeline. Other makes of tokenizers are refused.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's name in a text is ordinary text
        self.model, self.letters, self.cut = self.tokenizer.model, _byte_letters(), None
        made = json.loads(self.tokenizer.to_str())
        pre, norm = made["pre_tokenizer"] or {}, made["normalizer"] or {}
        if [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            cuts, level = (pre.get("pretokenizers", []) + [{}, {}])[:2]
            if cuts.get("type") == "Split" and cuts.get("invert") and level.get("type") == "ByteLevel" and made["model"]["type"] == "BPE":
                self.cut = regex.compile(cuts["pattern"]["Regex"]).findall
        if self.cut is None:
            raise ValueError(f"{path}: not a tokenizer that works word by word")

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and word.islower():
            out = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        elif not _PLAIN.fullmatch(word):
            out = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        elif (low := word.lower()) != word:
            return self[low]
        elif not word.isalpha() and len(pieces := self.cut(word)) > 1:
            return b"".join(map(self.__getitem__, pieces))
        else:
            said = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            out = array("I", [t.id for t in self.model.tokenize(said)]).tobytes()
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out
        return out


@lru_cache(maxsize=2)
def _ids(path: str) -> _Ids:
    return _Ids(path)


def encode(text: str | None, path: str) -> bytes:
    """Ids of a whole text as little-endian uint32 bytes; null has none.

    The tokenizer drops white space and works word by word, so a text's ids are its words' ids one after
    another; a worker remembers the ids of the words it meets.
    """
    if not text:
        return b""
    ids = _ids(path).__getitem__
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return b"".join(map(ids, text.replace("\n", " ").split(" ")))
    # Here lower case goes letter by letter, as in the tokenizer, and a run of letters is one of its pieces.
    return b"".join(map(ids, _RUNS(text.lower())))


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into token files at ``path`` in ascending doc_id order; return them, read back.

    Null texts are empty documents (only the end id); a null doc_id sorts first; equal doc_ids follow each
    other in the order of their texts. One shuffle moves the texts by ranges of doc_id; ids, larger than
    texts, are made after it and only written.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches):
        from pyspark import TaskContext

        name = tokenizer or default_tokenizer()
        part, start = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids = [encode(t, name) + end for t in b.column("text").to_pylist()]
            n = np.array([len(x) >> 2 for x in ids], np.int64)
            ends = np.cumsum(n)
            for lo in range(0, len(ids), 512):  # small batches: arrays of ids are several times their texts
                hi = min(lo + 512, len(ids))
                offsets = np.concatenate(([0], np.cumsum(n[lo:hi]))).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids[lo:hi]), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(lo, hi - lo),
                        pa.array(np.full(hi - lo, part, np.int32)),
                        pa.array(start + ends[lo:hi] - n[lo:hi]),
                        pa.array(n[lo:hi].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets), flat),
                    ],
                    names=["doc_id", "part", "local_start", "n_tokens", "token_ids"],
                )
            start += int(ends[-1]) if len(ids) else 0

    (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, FORMAT)
        .write.options(**WRITER)
        .parquet(path)
    )
    return read_token_files(spark, path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FORMAT).parquet(path)


def part_starts(files: DataFrame) -> DataFrame:
    """(part, part_start): ids in all parts before. Reads two number columns only; a row for each part."""
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("ids_in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("ids_in_part").over(before), F.lit(0)).alias("part_start"))


def token_digest(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read from token files, a row for each of theirs; empty files give no rows."""

    def run(batches):
        for b in batches:
            lists = b.column("token_ids")
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("part"), b.column("local_start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"],
            )

    digests = files.select("doc_id", "part", "local_start", "token_ids").mapInArrow(
        run, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long"
    )
    # As many rows as the writing stage had tasks.
    starts = F.broadcast(part_starts(files))
    return digests.join(starts, "part").select(
        "doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each row of ``documents`` as its token file holds it; null texts are the end id alone, rows with equal ids follow in the order of their texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_digest(write_token_files(docs, scratch(spark, "tokens")))
