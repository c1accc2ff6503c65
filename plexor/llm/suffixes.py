"""Suffix order of a buffer of bytes by two-stage sorting, and what neighbours in it have in common.

A suffix smaller than its successor (the suffix one byte later) is of type B, any other of type A.
Only suffixes of type B are sorted directly.  Those of type A follow by a scan of the buckets of
first bytes in ascending order: a suffix of type A is larger than its successor, so its place in
its own bucket, before all of type B there, is decided when the scan meets the successor.
Order is by the first DEPTH bytes, and a common prefix counts up to `depth` bytes.
"""

from __future__ import annotations

import numpy as np

#: Bytes by which suffixes are put in order: one word of 8 and further ones of 5.
DEPTH = 53


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on as a big-endian number, zeros after the end."""
    padded = np.zeros(len(data) + 64, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(shape=(len(data) + 56,), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)


def type_b(data: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the last is not."""
    n = len(data)
    place = np.arange(n)
    differs = np.zeros(n, bool)
    differs[:-1] = data[:-1] != data[1:]
    differs[-1] = True
    # An equal byte is of its successor's type: look where the run of equal bytes ends.
    end = np.minimum.accumulate(np.where(differs, place, n)[::-1])[::-1]
    after = np.minimum(end + 1, n - 1)
    return (end < n - 1) & (data < data[after])


def sorted_directly(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The suffixes that begin at `at`, in order of their first DEPTH bytes."""
    key = words[at]
    order = np.argsort(key)
    at, key = at[order], key[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(at) else np.zeros(0, np.int64)
    open_ = np.arange(len(at))
    for off in range(8, DEPTH, 5):
        # Only suffixes that are still equal to a neighbour go on.
        g = group[open_]
        same = np.zeros(len(open_), bool)
        eq = g[1:] == g[:-1]
        same[1:] |= eq
        same[:-1] |= eq
        open_ = open_[same]
        if not len(open_):
            break
        g = g[same]
        dense = np.cumsum(np.concatenate([[True], g[1:] != g[:-1]])).astype(np.uint64)
        key = (dense << np.uint64(40)) | (words[at[open_] + off] >> np.uint64(24))
        order = np.argsort(key)
        at[open_] = at[open_][order]
        group[open_] = np.cumsum(np.concatenate([[True], np.diff(key[order]) != 0]))
    return at


def suffix_order(data: np.ndarray, wanted: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """The wanted suffixes (a mask of places) in order of their first bytes, DEPTH at least for those sorted directly."""
    n = len(data)
    if not n or not wanted.any():
        return np.zeros(0, np.int64)
    words = words_at(data) if words is None else words
    small = type_b(data)
    # To be induced, a suffix needs its successors up to the next one of type B.
    place = np.arange(n)
    next_b = np.minimum.accumulate(np.where(small, place, n - 1)[::-1])[::-1]
    last = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, last, 1)
    np.add.at(cover, next_b[last] + 1, -1)
    needed = wanted | (np.cumsum(cover[:-1]) > 0)

    direct = sorted_directly(words, np.flatnonzero(needed & small))
    first = data[direct]
    bounds = np.searchsorted(first, np.arange(257))
    induced = needed & ~small
    coming: list[list[np.ndarray]] = [[] for _ in range(256)]
    if induced[n - 1]:
        coming[data[n - 1]].append(np.array([n - 1]))  # followed by nothing, which is smaller than all
    out = []
    for byte in range(256):
        queue = np.concatenate(coming[byte]) if coming[byte] else np.zeros(0, np.int64)
        scanned = []
        while len(queue):
            scanned.append(queue)
            before = queue[queue > 0] - 1
            queue = before[induced[before] & (data[before] == byte)]
        scanned.append(direct[bounds[byte] : bounds[byte + 1]])
        bucket = np.concatenate(scanned)
        coming[byte] = []
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        heads = data[before]
        ahead = induced[before] & (heads > byte)
        before, heads = before[ahead], heads[ahead]
        if len(before):
            dealt = np.argsort(heads, kind="stable")
            before, heads = before[dealt], heads[dealt]
            for part in np.split(before, np.flatnonzero(heads[1:] != heads[:-1]) + 1):
                coming[data[part[0]]].append(part)
    order = np.concatenate(out)
    return order[wanted[order]]


def common_prefixes(words: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes, up to depth, that each suffix of `order` has in common with the one before it (the first: none)."""
    out = np.zeros(len(order), np.int64)
    open_ = np.ones(max(0, len(order) - 1), bool)
    for off in range(0, depth, 8):
        w = words[order + off]
        x = w[1:] ^ w[:-1]
        ends = np.flatnonzero(open_ & (x != 0))
        # Leading zero bytes of what differs.
        top = x[ends]
        lead = np.zeros(len(top), np.int64)
        for bits in (32, 16, 8):
            high = top >> np.uint64(64 - bits) == 0
            lead += high * (bits // 8)
            top = np.where(high, top << np.uint64(bits), top)
        out[ends + 1] = off + lead
        open_[ends] = False
    out[1:][open_] = depth
    return np.minimum(out, depth)
