"""Many small numbers as a few rows: packed arrays dealt by hash range, one row per task part and range."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text per hash range; the number of ranges grows with the input so that a range stays in a task's memory.
RANGE_BYTES = 6_000_000
LEAST_RANGES = 16


def text_ranges(docs: DataFrame, text_col: str, size: int = RANGE_BYTES) -> int:
    """How many hash ranges to deal the parts of all texts to, one for every ``size`` bytes."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    return max(LEAST_RANGES, -(-total // size))


def schema(columns: dict[str, type]) -> str:
    return ", ".join(["part int", *(f"{c} binary" for c in columns)])


def pack(part: np.ndarray, columns: dict[str, np.ndarray], kinds: dict[str, type]) -> pa.RecordBatch:
    """A row for each value of ``part``."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    starts = np.flatnonzero(np.diff(part, prepend=-2))
    ends = np.append(starts[1:], len(part))[: len(starts)]
    arrays: list[pa.Array] = [pa.array(part[starts].astype(np.int32), pa.int32())]
    for c, kind in kinds.items():
        own = np.ascontiguousarray(columns[c][order].astype(kind, copy=False))
        arrays.append(pa.array([own[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["part", *kinds])


def unpack(table: pa.Table, kinds: dict[str, type]) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in kinds.items()}


def reduce_parts(packed: DataFrame, fn: Callable[[dict[str, np.ndarray]], pa.Table], kinds: dict[str, type], out: str) -> DataFrame:
    """``fn`` over all numbers of each range."""

    def run(table: pa.Table) -> pa.Table:
        return fn(unpack(table, kinds))

    return packed.groupBy("part").applyInArrow(run, out)


def part_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each 64-bit hash, by its upper half."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


def firsts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any key."""
    n = len(sorted_keys[0])
    out = np.ones(n, bool)
    if n > 1:
        same = np.ones(n - 1, bool)
        for k in sorted_keys:
            same &= k[1:] == k[:-1]
        out[1:] = ~same
    return out


def grouped_lists(keys: list[np.ndarray], names: list[str], lists: dict[str, np.ndarray], kinds: dict[str, pa.DataType]) -> pa.Table:
    """A row for each distinct key with the lists of its rows in their order."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    at = np.flatnonzero(firsts(*keys)) if len(order) else np.zeros(0, np.int64)
    ends = np.append(at, len(order)).astype(np.int32)
    columns = [pa.array(k[at], pa.int64()) for k in keys]
    for c, values in lists.items():
        columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[order], kinds[c])))
    return pa.table(columns, [*names, *lists])


def batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from table.to_batches()
