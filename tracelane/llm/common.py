"""What the text operators share: shared scratch tables, Arrow helpers, 64-bit hashing of byte ranges."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A null identifier counts as this one, the largest there is.
NULL_ID = 2**63 - 1
#: Bytes 32 and 9-13: white space in the word pattern ``[^\x20\x09-\x0D]+``.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
_SPACE_LUT = np.zeros(256, bool)
_SPACE_LUT[list(SPACE_BYTES)] = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the folder that driver and executors share, to cut lineage.

    The folder is ``spark.checkpoint.dir`` of the session. Only a session in one JVM (``local[n]``) may leave it unset,
    since all its tasks see the driver's temporary folder; any other session without it is refused. A table lives until
    ``drop`` or, because results are lazy and may still read it, until the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = f"{tempfile.gettempdir()}/spark-checkpoints"
        self.folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path)

    def save(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and read it back; its shuffle files are released when the write is done."""
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        path = f"{self.folder}/{label}"
        try:
            if before is not None:
                self.spark.conf.set(key, "true")
            df.write.mode("overwrite").parquet(path)
        finally:
            if before is not None:
                self.spark.conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        for label in labels:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{label}"), True)


def id_key(column: str) -> Column:
    """The identifier as a long that is never null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def trim() -> None:
    """Give what a worker has freed back to the system; else large arrays of one stage stay with the next ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library cannot
        ctypes.CDLL(None).malloc_trim(0)


def arrow_udf(kind: T.DataType | str) -> Callable:
    """``F.arrow_udf`` whose worker is trimmed after each batch."""

    def wrap(fn: Callable[..., pa.Array]):
        @functools.wraps(fn)
        def run(*columns):
            try:
                return fn(*columns)
            finally:
                trim()

        return F.arrow_udf(run, kind)

    return wrap


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``fn`` over each Arrow batch of each partition."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
                trim()

    return df.mapInArrow(run, schema)


def strings(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column as one uint8 array; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[where[0] : where[-1]], where - where[0]


def chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a row is never split."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(stop, rows)
        start = min(stop, rows)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values, kind))


# ---- hashing of byte ranges ------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STRIDE_LOG2 = 16


@functools.lru_cache(maxsize=4)
def _low_powers(base: int) -> np.ndarray:
    steps = np.full(1 << _STRIDE_LOG2, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2^64; only a table of 2^16 of them is kept."""
    low = _low_powers(base)
    high = np.full(-(-n >> _STRIDE_LOG2) if n > 0 else 0, pow(base, 1 << _STRIDE_LOG2, 2**64), np.uint64)
    high[:1] = 1
    return (np.cumprod(high)[:, None] * low[None, : min(n, len(low))]).ravel()[:n]


class RangeHash:
    """Equal byte ranges get equal 64-bit values wherever they start; ranges may be of any length.

    A polynomial modulo 2^64 with an odd base, made independent of the start by the inverse power, then mixed.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self._sums = np.zeros(n + 1, np.uint64)
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= _powers(_BASE, n)
        np.cumsum(terms, out=self._sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        low = _low_powers(_INVERSE)
        high = _powers(pow(_INVERSE, 1 << _STRIDE_LOG2, 2**64), (len(self._sums) >> _STRIDE_LOG2) + 1)
        raw = (self._sums[ends] - self._sums[starts]) * low[starts & (len(low) - 1)] * high[starts >> _STRIDE_LOG2]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, width: int) -> np.ndarray:
        """Of every range of ``width`` bytes."""
        n = len(self._sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self._sums[width:] - self._sums[:-width]) * _powers(_INVERSE, n))

    def windows_at(self, width: int, at: np.ndarray) -> np.ndarray:
        """windows(width)[at], at the cost of these only."""
        high = _powers(pow(_INVERSE, 1 << _STRIDE_LOG2, 2**64), (len(self._sums) >> _STRIDE_LOG2) + 1)
        return mix((self._sums[at + width] - self._sums[at]) * _low_powers(_INVERSE)[at & ((1 << _STRIDE_LOG2) - 1)] * high[at >> _STRIDE_LOG2])


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE_LUT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of all words ``[^\\x20\\x09-\\x0D]+`` (or of other ``space``, a flag per byte); a row's end also ends a word."""
    if space is _SPACE_LUT:  # the same by arithmetic, several times as fast as a table
        inside = (data != 32) & ((data - np.uint8(9)) > 4)
    else:
        inside = ~space[data]
    cut = np.zeros(len(data) + 1, bool)  # before a byte that begins a row, or that no byte of a word precedes or follows
    cut[offsets] = True
    cut[1:-1] |= inside[1:] != inside[:-1]
    starts = np.flatnonzero(inside & cut[:-1])
    ends = np.flatnonzero(inside & cut[1:]) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, made longer while a column is called so, in whatever case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def with_columns_last(df: DataFrame, names: list[str], new: dict[str, Column]) -> DataFrame:
    """``names`` of ``df`` without those in ``new`` (in whatever case), then ``new``."""
    gone = {c.lower() for c in new}
    return df.select(*[F.col(f"`{x}`") for x in names if x.lower() not in gone], *[c.alias(k) for k, c in new.items()])


def with_fields(df: DataFrame, struct: Column, fields: Iterable[str]) -> DataFrame:
    """``df`` with ``fields`` of ``struct`` as its last columns, in place of input columns of these names."""
    own = fresh(df.columns, "__fields")
    return with_columns_last(df.withColumn(own, struct), df.columns, {c: F.col(f"`{own}`.`{c}`") for c in fields})
