"""What the operators of this subpackage share: word splitting, hashing, batching, tables cut from lineage."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator
from functools import wraps
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..shared import shared_dir

#: Text bytes that one worker handles at a time; longer texts are handled alone.
CHUNK_BYTES = 4 << 20
#: Entries after which a worker's per-word cache starts anew.
CACHE_WORDS = 400_000

_MUL = np.uint64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Spark's own setting to remove a query's shuffle files once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back. Its shuffle files go at once, the table when the driver's Python ends or by drop()."""
    path = f"{shared_dir(spark).rstrip('/')}/tessera/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop(df: DataFrame, spark: SparkSession) -> None:
    """Remove the files of a table() that nothing will read again."""
    _drop(spark, df._tessera_path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already; what is left is only space
        pass


def released(f):
    """The function over batches for mapInArrow; its worker gives memory back to the system when a task has ended.

    Spark keeps idle workers, and starts more where short tasks overlap; each would keep what its largest task took.
    """

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Memory that is free in Arrow's pool and in malloc's heaps goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def carried(df: DataFrame, keep: tuple[str, ...]) -> tuple[list[str], str]:
    """Columns to pass through beside those an operator reads, and their part of a schema."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return list(keep), "".join(f"{c} {kinds[c]}, " for c in keep)


def words(text: str | None) -> list[bytes]:
    """The runs of bytes other than space and 0x09 to 0x0D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def chunked(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most so many bytes of the column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


class WordHash(dict):
    """64-bit hashes of words, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def flat(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words one after another, and where each document starts (one entry more than documents)."""
        if len(self) > CACHE_WORDS:
            self.clear()
        starts = np.zeros(len(docs) + 1, np.int64)
        np.cumsum([len(d) for d in docs], out=starts[1:])
        return np.fromiter(map(self.__getitem__, chain.from_iterable(docs)), np.uint64, int(starts[-1])), starts


def mix(a: np.ndarray) -> np.ndarray:
    a = a ^ (a >> np.uint64(32))
    a *= np.uint64(0xD6E8FEB86659FD93)
    a ^= a >> np.uint64(29)
    return a


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    a = h[:n].copy()
    for j in range(1, k):
        a *= _MUL
        a += h[j : j + n]
    return mix(a)


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def packed(parts: list[np.ndarray]) -> pa.Array:
    """A binary array with the bytes of each part."""
    return pa.array([p.tobytes() for p in parts], pa.binary())
