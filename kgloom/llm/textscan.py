"""Word scanning and hashing of Arrow text columns with numpy.

A batch of texts is handled as one byte array.  Words are maximal runs of bytes
outside ASCII white space (x20, x09-x0D), which equals the word rule on code
points because those bytes never occur inside a longer UTF-8 sequence.  Every
sequence of words is named by a polynomial over 64-bit word names, so any span
costs two look-ups in a running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 4_000_000          # bytes of text handled at a time in a worker
U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95   # odd multipliers
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base & (2**64 - 1), U)
        p[0] = 1
        have = _powers[base] = np.multiply.accumulate(p)
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser with full avalanche (the public splitmix64 step)."""
    x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) in pieces of about PIECE_BYTES; null is empty."""
    column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], wide)[column.offset:column.offset + n + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + PIECE_BYTES, "right")) - 1)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


class Words:
    """The words of a piece: names, and the row bounds in word positions."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False):
        if lower:
            data = _LOWER[data]
        n = len(data)
        solid = ~_SPACE[data]
        before = np.zeros(n + 1, bool)           # before[i]: byte i continues a word of its row
        before[1:] = solid
        before[off] = False
        start = np.flatnonzero(solid & ~before[:n])
        after = np.zeros(n + 1, bool)
        after[:n] = solid
        after[off] = False
        end = np.flatnonzero(solid & ~after[1:]) + 1
        total = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * powers(_BYTE_BASE, n), out=total[1:])
        undo = powers(pow(_BYTE_BASE, -1, 2**64), n + 1)
        self.name = mix((total[end] - total[start]) * undo[start] + (end - start).astype(U), 1)
        self.row = np.searchsorted(start, off)   # word positions where rows begin
        self.n = len(start)
        self.start, self.end, self.data = start, end, data
        run = np.zeros(self.n + 1, U)
        np.cumsum(self.name * powers(_WORD_BASE, self.n), out=run[1:])
        self._run, self._undo = run, powers(pow(_WORD_BASE, -1, 2**64), self.n + 1)

    def span(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Names of the word sequences [lo, hi)."""
        return mix((self._run[hi] - self._run[lo]) * self._undo[lo] + (hi - lo).astype(U), 2)


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64))
