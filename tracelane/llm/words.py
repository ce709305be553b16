"""Words of a column as numbers: exact codes within a slice, 64-bit names everywhere."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from tracelane.llm.common import SPACE_BYTES, byte_view, chunks, lower_ascii, word_spans

#: Bytes of text that are taken at once; a longer text is taken alone.
SLICE_BYTES = 4_000_000


def byte_flags(members: bytes) -> np.ndarray:
    """A flag per byte value."""
    flags = np.zeros(256, bool)
    flags[list(members)] = True
    return flags


_SPACE = byte_flags(SPACE_BYTES)


class Words(NamedTuple):
    """``start``, ``row`` and ``code`` of each word of a slice, in order; ``unique`` has the word of each code."""

    start: np.ndarray
    row: np.ndarray
    code: np.ndarray
    unique: pa.Array


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> Words:
    """Words between bytes of ``space``, A-Z lower-cased. Bytes above 127 are never space, so UTF-8 is never cut."""
    data = lower_ascii(data)
    start, end, row = word_spans(data, offsets, space)
    ends = np.concatenate([[0], np.cumsum(end - start)])
    joined = np.ascontiguousarray(data[~space[data]])
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(joined)])
    coded = whole.dictionary_encode()
    return Words(start, row, coded.indices.to_numpy().astype(np.int64), coded.dictionary)


def names(unique: pa.Array, salt: bytes = b"") -> np.ndarray:
    """A 64-bit name per word by a cryptographic hash, so that no text can be written to make names meet."""
    return np.array([int.from_bytes(blake2b(w, digest_size=8, key=salt).digest(), "little") for w in unique.to_pylist()], np.uint64)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, bytes, offsets) of slices of a text column; null counts as empty."""
    data, offsets = byte_view(column)
    for a, b in chunks(offsets, limit):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
