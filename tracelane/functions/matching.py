"""Matching blocks of two sequences: the longest common run, then the same on both sides of it (Ratcliff-Obershelp)."""

from __future__ import annotations

from collections.abc import Hashable, Sequence
from difflib import SequenceMatcher

import numpy as np

#: Pairs of places for which the lengths of common runs are kept as a table (2 bytes each); larger areas are swept row by row.
TABLE_CELLS = 1 << 23
#: Below this many pairs of places the standard library's matcher is faster.
SMALL_CELLS = 3000
_DOWN = np.arange(1 << 13, 0, -1, dtype=np.int16)


def _run_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[i, j]: how many steps from a[i] and b[j] on are equal; neither has more than 2^13 steps."""
    equal = (a[:, None] == b[None, :]).astype(np.int16)
    runs = np.zeros((len(a) + 1, len(b) + 1), np.int16)
    for i in range(len(a) - 1, -1, -1):
        row = runs[i, :-1]
        np.add(runs[i + 1, 1:], 1, out=row)
        row *= equal[i]
    return runs


def _longest_in_table(runs: np.ndarray) -> tuple[int, int, int]:
    """(length, i, j) of the longest run that ends within the table's part; of equal ones the first in a, then in b."""
    rows, columns = runs.shape
    fits = np.minimum(runs, _DOWN[-columns:])
    np.minimum(fits, _DOWN[-rows:, None], out=fits)
    at = int(fits.argmax())
    i, j = divmod(at, columns)
    return int(fits[i, j]), i, j


def _longest_by_sweep(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The same from a row at a time, with memory for one row."""
    best, row = (0, 0, 0), np.zeros(len(b) + 1, np.int32)
    for i in range(len(a) - 1, -1, -1):
        row[:-1] = (row[1:] + 1) * (b == a[i])
        j = int(row.argmax())
        if row[j] and row[j] >= best[0]:  # rows come last to first: of equal runs the first row counts
            best = (int(row[j]), i, j)
    return best


def matching_blocks(a: Sequence[Hashable], b: Sequence[Hashable], cells: int = TABLE_CELLS) -> list[tuple[int, int, int]]:
    """(i, j, n): a[i : i + n] equals b[j : j + n]; in order, adjacent ones joined, without the empty one at the end.

    Each step of the search takes the longest run that lies in what is left, the first in ``a`` of equal ones, then the first
    in ``b``. Areas of up to ``cells`` pairs share one table of run lengths, so a step there is one maximum over its part.
    """
    if len(a) * len(b) <= min(SMALL_CELLS, cells):
        return [tuple(x) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]]
    codes: dict[Hashable, int] = {}
    a, b = (np.array([codes.setdefault(x, len(codes)) for x in s], np.int64) for s in (a, b))
    found, open_ = [], [(0, len(a), 0, len(b), None)]
    while open_:
        low, high, left, right, table = open_.pop()
        if low >= high or left >= right:
            continue
        if table is None and (high - low) * (right - left) <= cells and max(high - low, right - left) < len(_DOWN):
            table = (_run_table(a[low:high], b[left:right]), low, left)
        if table is None:
            n, i, j = _longest_by_sweep(a[low:high], b[left:right])
        else:
            runs, top, side = table
            n, i, j = _longest_in_table(runs[low - top : high - top, left - side : right - side])
        if n:
            i, j = low + i, left + j
            found.append((i, j, n))
            open_ += [(low, i, left, j, table), (i + n, high, j + n, right, table)]
    joined: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            joined[-1] = (*joined[-1][:2], joined[-1][2] + n)
        else:
            joined.append((i, j, n))
    return joined
