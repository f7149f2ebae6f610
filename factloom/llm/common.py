"""What the operators of this subpackage share: inputs, shared scratch tables, word hashing in tasks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: The characters that separate words, as bytes: space and 0x09 to 0x0D.
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-factloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Lists that take the paths of the tables written from now on (see made).
_takers: list[list[str]] = []


@contextmanager
def made(paths: list[str]):
    """Adds to paths those of the tables that are written within."""
    _takers.append(paths)
    try:
        yield
    finally:
        _takers.pop()


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that nothing reads any more, and empties the list of their paths."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch in jobs that write a table: texts are long, and a batch is in memory several times.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives lost executors. Python tasks get small batches."""
    spark = df.sparkSession
    path = new_path(spark, what)
    for paths in _takers:
        paths.append(path)
    name, rows = BATCH_ROWS
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def trimmed(run):
    """run (over Arrow batches), after which the worker gives free memory back: workers are used again, and what one task needed
    would else stay theirs while other tasks need it."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return go


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def randoms(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; nulls have no bytes."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, at


def slices(at: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes; a longer row is a run by itself."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of consecutive rows: where each starts and ends, its row, and a 64-bit hash."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False, seeds: tuple[int, ...] = (1,), letters: np.ndarray | None = None):
        """letters: for each byte, whether it belongs to words; all but white space if not given."""
        base = int(at[0])
        data, at = data[base : int(at[-1])], at - base
        self.rows = len(at) - 1
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data, self.at = data, at
        word = ~((data == 32) | ((data >= 9) & (data <= 13))) if letters is None else letters[data]
        before, after = np.empty_like(word), np.empty_like(word)
        if len(word):
            before[0], before[1:] = False, word[:-1]
            after[-1], after[:-1] = False, word[1:]
            edges = at[(at > 0) & (at < len(data))]
            before[edges] = False
            after[edges - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, at)  # of each row, and the end
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.count)
        self.word = word
        self.hash = [self.hashed(s) for s in seeds]

    def hashed(self, seed: int, most: int | None = None) -> np.ndarray:
        """Hashes of the words, or of their first `most` bytes."""
        word = self.word
        if not len(self.start):
            return np.zeros(0, np.uint64)
        s0 = int(self.start[0])
        d, st = self.data[s0:], self.start - s0
        place = np.arange(len(d)) - np.repeat(st, np.diff(np.append(st, len(d))))
        length = self.end - self.start
        place = np.minimum(place, int(length.max()) - 1)
        chars = randoms(256, seed * 7919)
        with np.errstate(over="ignore"):
            values = (randoms(int(length.max()), seed * 104729) | np.uint64(1))[place] * chars[d]
            values[~word[s0:]] = 0
            if most is not None:
                values[place >= most] = 0
                length = np.minimum(length, most)
            return mix(np.add.reduceat(values, st) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def runs(self, k: int) -> np.ndarray:
        """Indices of the words at which k words of one row start."""
        n = len(self.start)
        if n < k:
            return np.zeros(0, np.int64)
        i = np.arange(n - k + 1)
        return i[self.row[i] == self.row[i + k - 1]]

    def windows(self, k: int, which: int = 0) -> np.ndarray:
        """A hash of the k words from each word on (of len - k + 1 words, across rows too)."""
        return windows(self.hash[which], k)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive values, from those of powers of two."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
    with np.errstate(over="ignore"):
        out, done, power, size = None, 0, h, 1
        while True:
            if k & size:
                part = power[done : done + n]
                out = part.copy() if out is None else mix(out * a + part * b + np.uint64(size))
                done += size
            size *= 2
            if size > k:
                return out
            half = size // 2
            power = mix(power[:-half] * a + power[half:] * b)


#: A side of a join is broadcast up to this many rows or bytes of its written table; beyond, Spark shuffles both.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 48 << 20


def _bytes_beyond(kind: DataType, value: Column) -> Column | None:
    """What a value takes beyond its place in the row, for columns of any length."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.octet_length(value)
    if isinstance(kind, ArrayType):
        inner = _bytes_beyond(kind.elementType, F.lit(None).cast(kind.elementType))
        flat = F.size(value) * 8
        return flat if inner is None else flat + F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(_bytes_beyond(kind.elementType, x), F.lit(0)))
    if isinstance(kind, StructType):
        parts = [F.lit(16), *(F.coalesce(b, F.lit(0)) for f in kind.fields if (b := _bytes_beyond(f.dataType, value[f.name])) is not None)]
        return reduce(lambda x, y: x + y, parts)
    return None


def small_enough(table: DataFrame, row_bytes: int = 64) -> bool:
    """Whether a written table may be broadcast: by its rows, each of row_bytes, and what its strings, arrays and structs add.

    Without such columns this reads Parquet footers; else the columns themselves.
    """
    more = [b for f in table.schema.fields if (b := _bytes_beyond(f.dataType, F.col(f"`{f.name}`"))) is not None]
    if not more:
        return table.count() <= min(BROADCAST_ROWS, BROADCAST_BYTES // row_bytes)
    found = table.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(b), F.lit(0)).alias(f"b{i}") for i, b in enumerate(more)]).head()
    return found[0] <= BROADCAST_ROWS and found[0] * row_bytes + sum(found[1:]) <= BROADCAST_BYTES


def maybe_broadcast(table: DataFrame, row_bytes: int = 64) -> DataFrame:
    """A written table, hinted for broadcast only if its measured size is within the bound."""
    return F.broadcast(table) if small_enough(table, row_bytes) else table
