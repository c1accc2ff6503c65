"""Token ids of the lower-case word BPE, many documents at a time.

The tokenizer (NFC, lower case, white space dropped) cuts text into runs of letters, single
digits and runs of other characters, and merges within each run alone.  So runs are found and
hashed for whole blocks of documents at once, each distinct one is encoded once, and its
ids are copied for every further occurrence.

Runs are cut here only where that is certain to agree with the tokenizer: in ASCII without
control characters, apostrophes (contractions are cut otherwise) and ``<|`` (special tokens),
and in Latin letters U+00C0 to U+00FF.  Whatever else stands between two spaces goes
through the whole tokenizer in one piece.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from plexor.llm.words import Slab

#: Distinct runs that one Python worker remembers, some 60 MB; beyond, those that were met in one block alone are forgotten.
MEMO = 400_000

_SPACES = [9, 10, 11, 12, 13, 32]
#: Classes of bytes: 0 space, 1 letter, 2 digit, 3 other.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[_SPACES] = 0
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_ODD = np.zeros(256, bool)
_ODD[[b for b in range(256) if (b < 32 or b >= 127) and b not in _SPACES] + [ord("'")]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _cut(slab: Slab) -> tuple[Slab, np.ndarray, np.ndarray, np.ndarray]:
    """(the slab in lower case, starts and ends of the runs, which of them are whole odd pieces)."""
    data = slab.data
    kind, odd, low = _CLASS[data], _ODD[data], _LOWER[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[lead + 1 < len(data)]
    second = data[lead + 1]
    fine = (second != 0x97) & (second != 0xB7)  # the signs for times and divided by
    lead, second = lead[fine], second[fine]
    for at in (lead, lead + 1):
        kind[at], odd[at] = 1, False
    upper = lead[second <= 0x9E] + 1
    low[upper] += 0x20
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    odd[special] = True

    edge = np.zeros(len(data) + 1, bool)
    edge[slab.offsets] = True
    full = kind != 0
    before = np.concatenate([[False], full[:-1]])
    starts = np.flatnonzero(full & (~before | edge[:-1]))
    if odd.any():
        run = np.zeros(len(data) + 1, np.int32)
        np.cumsum(odd, out=run[1:])
        after = np.concatenate([full[1:], [False]])
        ends = np.flatnonzero(full & (~after | edge[1:])) + 1
        bad = run[ends] > run[starts]
        for s, e in zip(starts[bad].tolist(), ends[bad].tolist()):
            kind[s:e] = 4
    change = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 2)])  # each digit is a run
    begin = full & (change | edge[:-1])
    finish = full & (np.concatenate([change[1:], [True]]) | edge[1:])
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return Slab(slab.first, low, slab.offsets), starts, ends, kind[starts] == 4


class TokenTable:
    """Remembers the ids of runs.  `path` is a tokenizers file of the kind described above."""

    def __init__(self, path: str, memo: int = MEMO, special: bool = True):
        """special: names of special tokens in a text become those tokens, else they are ordinary text."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.memo = memo
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        # The byte alphabet of byte-level BPE: visible bytes stand for themselves, the others follow from U+0100.
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.starts, self.sizes, self.blocks = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(8192, np.uint32), 0

    def forget(self) -> None:
        """Drops the runs that were met in one block alone since the last time; all of them if that leaves too many."""
        old, starts, sizes, flat = list(self.at), self.starts, self.sizes, self.flat
        keep = np.flatnonzero(self.blocks[: len(old)] > 1).tolist()
        self.clear()
        for i in keep if 2 * len(keep) <= self.memo else []:
            self._add(old[i], flat[starts[i] : starts[i] + sizes[i]])

    def _encode(self, run: bytes, odd: bool) -> list[int]:
        if odd:
            return self.tokenizer.encode(run.decode("utf-8", "replace"), add_special_tokens=False).ids
        return [t.id for t in self.tokenizer.model.tokenize(run.decode("latin-1").translate(self.alphabet))]

    def _add(self, key: int, ids: list[int] | np.ndarray) -> int:
        i = self.at[key] = len(self.at)
        if i >= len(self.starts):
            self.starts, self.sizes, self.blocks = (np.resize(x, 2 * i) for x in (self.starts, self.sizes, self.blocks))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[i], self.sizes[i], self.blocks[i] = self.used, len(ids), 0
        self.used += len(ids)
        return i

    def ids(self, slab: Slab) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents in a row, each document's bounds in them)."""
        if not len(slab.data):
            return np.zeros(0, np.uint32), np.zeros(len(slab) + 1, np.int64)
        if len(self.at) > self.memo:
            self.forget()
        low, starts, ends, odd = _cut(slab)
        low.prepare(lower=False)
        hashes = low.hashes(starts, ends)
        if odd.any():
            slab.prepare(lower=False)
            hashes = np.where(odd, ~slab.hashes(starts, ends), hashes)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        have = self.at.get
        found = [have(k, -1) for k in keys.tolist()]
        for j in [j for j, i in enumerate(found) if i < 0]:
            at = first[j]
            source = slab if odd[at] else low
            found[j] = self._add(int(keys[j]), self._encode(source.data[starts[at] : ends[at]].tobytes(), bool(odd[at])))
        own = np.array(found, np.int64)
        self.blocks[own] += 1
        entry = own[back]
        size = self.sizes[entry]
        run = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=run[1:])
        flat = self.flat[np.repeat(self.starts[entry] - run[:-1], size) + np.arange(run[-1])]
        return flat, run[np.searchsorted(starts, slab.offsets)]


@lru_cache(maxsize=1)
def token_table(path: str, special: bool = True) -> TokenTable:
    """A worker's own table, which its next task finds again."""
    return TokenTable(path, special=special)
