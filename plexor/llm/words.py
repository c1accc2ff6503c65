"""Words of UTF-8 texts as arrays of 64-bit hashes, many documents at a time.

A word is ``[^\\x20\\x09-\\x0D]+``; its bytes are never part of a longer UTF-8 sequence's
white space, so whole columns are handled as one byte buffer.  The hash of any byte range
comes from one running sum H: with T a table of random 64-bit numbers by byte value and an
odd P, range [s, e) hashes to (H[e] - H[s]) * P^-s, H[i] = sum over j < i of T[b_j] * P^j, all mod 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is a slab of its own.
SLAB = 1 << 17
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_EXACT = mix(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)))
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, SLAB + 1), base, np.uint64)
        x[0] = 1
        have = np.multiply.accumulate(x)
        if n <= SLAB + 1:
            _POWERS[base] = have
    return have[:n]


@dataclass
class Slab:
    """Some documents in a row: their bytes, and where each begins and ends in them."""

    first: int  # number of the first document in its batch
    data: np.ndarray
    offsets: np.ndarray  # one more than documents
    sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def prepare(self, lower: bool) -> None:
        values = (_LOWER if lower else _EXACT)[self.data]
        values *= _powers(_P, len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges, after prepare()."""
        raw = (self.sums[ends] - self.sums[starts]) * _powers(_P_INVERSE, len(self.data) + 1)[starts]
        return mix(raw + (ends - starts).astype(np.uint64))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, bounds): document i has words bounds[i] to bounds[i + 1]."""
        full = ~_SPACE[self.data]
        edge = np.zeros(len(full) + 1, bool)
        edge[self.offsets] = True
        begin, end = full.copy(), full.copy()
        begin[1:] &= ~full[:-1] | edge[1:-1]
        end[:-1] &= ~full[1:] | edge[1:-1]
        starts = np.flatnonzero(begin)
        return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, self.offsets)

    def counted(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document are marked."""
        run = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=run[1:])
        return run[self.offsets[1:]] - run[self.offsets[:-1]]


def windows(w: np.ndarray, bounds: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words within a document, and the documents' bounds in them.

    short: a document of fewer words (but some) has one run, its whole sequence.
    """
    n = np.diff(bounds)
    count = np.maximum(n - width + 1, 0)
    new = np.concatenate([[0], np.cumsum(np.where((n > 0) & (count == 0), int(short), count))])
    at = np.repeat(bounds[:-1], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    out = np.full(len(at), width, np.uint64)
    golden = np.uint64(_P)
    for i in range(width):
        out = mix(out * golden + w[at + i])
    if short and new[-1] != len(out):
        whole = np.empty(new[-1], np.uint64)
        few = (n > 0) & (count == 0)
        slot = np.zeros(new[-1], bool)
        slot[new[:-1][few]] = True
        whole[~slot] = out
        for i in np.flatnonzero(few):
            h = np.full(1, n[i], np.uint64)
            for x in w[bounds[i] : bounds[i + 1]]:
                h = mix(h * golden + x)
            whole[new[i]] = h[0]
        out = whole
    return out, new


def slabs(column: pa.Array) -> Iterator[Slab]:
    """The rows of a string column, in order; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLAB, "right")) - 1)
        j = min(j, n)
        yield Slab(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
