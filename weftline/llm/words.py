"""Vectorised words and shingles of an Arrow text column.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, so words of UTF-8 text never split a
code point. Each word gets a 64-bit hash; a shingle's hash combines those of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text worked on at once; a longer text makes a piece of its own.
PIECE = 600_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    if _powers and n <= len(_powers[0]):
        return _powers
    back = pow(_STEP, -1, 1 << 64)
    made = [np.cumprod(np.concatenate([[U64(1)], np.full(max(n, PIECE + 1) - 1, U64(p))]), dtype=U64) for p in (_STEP, back)]
    if n <= PIECE + 1:  # those of a longer text are made for it alone
        _powers[:] = made
    return made


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about size bytes each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


class Words:
    """Words of the texts of one piece: start and end byte, row, and hash of each."""

    def __init__(self, column: pa.Array, fold: bool = True, hashes: bool = True):
        offsets, data = column.buffers()[1:]
        offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        first = int(offs[0])
        raw = np.frombuffer(data, np.uint8)[first : int(offs[-1])] if data is not None else np.zeros(0, np.uint8)
        self.offs, self.rows = offs - first, len(column)
        self.bytes = _FOLD[raw] if fold else raw
        solid = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.offs] = True
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        self.start = np.flatnonzero(solid & ~(before & ~edge[:-1]))
        self.end = np.flatnonzero(solid & ~(after & ~edge[1:])) + 1
        self.row = np.searchsorted(self.offs, self.start, side="right") - 1
        self.bounds = np.searchsorted(self.row, np.arange(self.rows + 1))
        self.hash = self._hash() if hashes else None

    def _hash(self) -> np.ndarray:
        n = len(self.bytes)
        up, down = _power(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[self.bytes] * up[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))

    def list(self) -> list[bytes]:
        whole = self.bytes.tobytes()
        return [whole[a:b] for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, bounds): every k-word shingle by row; of a row with fewer words, the whole sequence as one."""
        h, count = self.hash, np.diff(self.bounds)
        length = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
        bounds = np.concatenate([[0], np.cumsum(length)])
        out = np.empty(int(bounds[-1]), U64)
        if len(h) >= k:
            acc = h[: len(h) - k + 1].copy()
            for j in range(1, k):
                acc = acc * U64(0xD6E8FEB86659FD93) + h[j : len(h) - k + 1 + j]
            full = np.flatnonzero(self.row[: len(acc)] == self.row[k - 1 :])
            rows = self.row[full]
            out[bounds[rows] + full - self.bounds[rows]] = acc[full]
        for r in np.flatnonzero((count > 0) & (count < k)).tolist():
            acc = U64(0)
            with np.errstate(over="ignore"):
                for x in h[self.bounds[r] : self.bounds[r + 1]]:
                    acc = acc * U64(0xD6E8FEB86659FD93) + x
            out[bounds[r]] = acc + U64(count[r])
        return mix(out), bounds

    def sets(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, bounds): the distinct shingles of each row, ascending."""
        out, bounds = self.shingles(k)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[a:b].sort()
        fresh = np.ones(len(out), bool)
        fresh[1:] = out[1:] != out[:-1]
        heads = bounds[:-1][np.diff(bounds) > 0]
        fresh[heads] = True
        return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]


def place(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position in the row) of each item of a ragged array."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return row, np.arange(int(bounds[-1])) - bounds[row]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
