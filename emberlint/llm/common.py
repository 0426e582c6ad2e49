"""What the operators share: shared scratch tables, reading of tables, word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlint.sources.tables import scratch_path

#: Texts that a Python worker holds as arrays at one time, in bytes (a single longer text is one slice).
SLICE_BYTES = 4 << 20
#: Entries of a worker's word caches; a full cache is emptied and fills again.
CACHE_WORDS = 200_000


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the folder that the cluster shares; what is there goes when the process ends."""
    return scratch_path(spark, label)


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._emberlint_path = path
    return out


def discard(*written: DataFrame) -> None:
    """Remove what ``materialise`` wrote, once all that is built on it is written itself."""
    for df in written:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(df._emberlint_path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; others, whatever their names, are not read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Hand Python a few hundred texts at a time, unless the session says otherwise: workers hold a batch several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def input_bytes(df: DataFrame, *columns: str) -> int:
    """Bytes of UTF-8 in string columns, summed over all rows."""
    total = sum((F.coalesce(F.octet_length(c).cast("long"), F.lit(0)) for c in columns), F.lit(0))
    return df.agg(F.sum(total)).first()[0] or 0


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sliced(values: list[bytes], most: int = SLICE_BYTES):
    """Ranges (from, to) of neighbouring texts with about ``most`` bytes together."""
    lo = size = 0
    for i, x in enumerate(values):
        if size and size + len(x) > most:
            yield lo, i
            lo, size = i, 0
        size += len(x)
    if lo < len(values):
        yield lo, len(values)


class WordHash(dict):
    """Word (bytes) to its 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def hash_words(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(31))
    x = x * _M2
    return x ^ (x >> np.uint64(29))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of every ``n`` neighbouring word hashes (order counts)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = words[:m].copy()
    for k in range(1, n):
        out *= _M1
        out ^= out >> np.uint64(32)
        out += words[k : k + m]
    return mix(out * _M1)


class Bloom:
    """A fixed number of bits saying "surely not" or "perhaps"; only ever used to spare work, never to decide.

    The bits are built by the executors and merged by OR, so the driver holds ``bits / 8`` bytes whatever the
    number of keys; with more keys than bits the filter passes everything and results stay the same.
    """

    def __init__(self, data: bytes):
        self.bits = np.frombuffer(data, np.uint8)
        self.mask = np.uint64(len(data) * 8 - 1)

    @staticmethod
    def spots(keys: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        a = mix(keys.astype(np.uint64) * _M1)
        return a & mask, (a >> np.uint64(32)) * _M1 >> np.uint64(20) & mask

    def holding(self, ids: pa.Array) -> np.ndarray:
        """Whether each of a column of integers may be held; nulls always may."""
        ids = ids.cast(pa.int64())
        return ids.is_null().to_numpy(zero_copy_only=False) | self.passing(ids.fill_null(0).to_numpy().view(np.uint64))

    def passing(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for s in self.spots(keys, self.mask):
            out &= (self.bits[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def bloom_of(keys: DataFrame, most_bytes: int = 64 << 20) -> Bloom:
    """A filter over the single long column of ``keys``: a byte or two for each, at most ``most_bytes`` (a power of two)."""
    n = keys.count()
    size = 1 << 10
    while size < min(most_bytes, n):
        size *= 2
    mask = np.uint64(size * 8 - 1)

    def build(batches):
        bits = np.zeros(size, np.uint8)
        for b in batches:
            k = b.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
            for s in Bloom.spots(k, mask):
                np.bitwise_or.at(bits, s >> np.uint64(3), (1 << (s & np.uint64(7))).astype(np.uint8))
        used = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array([used.astype(np.uint32).tobytes()]), pa.array([bits[used].tobytes()])], names=["at", "bits"]
        )

    merged = np.zeros(size, np.uint8)
    # Few partitions: what reaches the driver at a time is one partition's bits, at most 5 bytes for each of ``size``.
    parts = keys.coalesce(max(1, min(8, n // 100_000 + 1))).mapInArrow(build, "at binary, bits binary")
    for row in parts.toLocalIterator():
        merged[np.frombuffer(row["at"], np.uint32)] |= np.frombuffer(row["bits"], np.uint8)
    return Bloom(merged.tobytes())


def perhaps_in(docs: DataFrame, bloom, inverse: bool = False) -> DataFrame:
    """Rows of ``docs`` whose doc_id a broadcast filter may hold, or with ``inverse`` the others."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(bloom.value.holding(b.column("doc_id")) != inverse))

    return docs.mapInArrow(run, docs.schema)
