"""Fill-in-middle transformation of whole texts, by one table-driven scan of their bytes.

1. A byte automaton's table is built once: its states say how much of a sentinel has been read,
   how many continuation bytes of a UTF-8 sequence are due, and whether a unit is open; each
   transition carries what it counts (a code point begins, a unit ends, a sentinel is complete).
2. The scan reads a slab of documents as one stream of bytes, with an end symbol after each
   document, in many lanes at once: the table is applied from every state to learn where each lane
   leads, the lanes are chained, and then each lane is read from the state that it begins in.
   Sums of the counts along the stream give units, code points and sentinels of every document.
3. A second pass finds the two cuts of each document among the ends of its units.

The cuts, the form and whether a text stays plain come from a SHA-256 of seed and doc_id, so they
depend on nothing else.

Defined cases: null and empty texts have no units and stay plain; so do texts that hold a sentinel;
a text of any length is read whole; a null doc_id is hashed as an empty number; repeated rows give
repeated rows; an empty table gives an empty result; further columns are ignored, whatever their
names.  A byte that UTF-8 does not allow where it stands counts as a code point of its own.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexor.llm.store import scan
from plexor.llm.words import slabs

#: What transitions count, as bits.
POINT, UNIT, SENTINEL = 1, 2, 4
#: The symbol after a document's last byte.
END = 256


@dataclass(frozen=True)
class Automaton:
    step: np.ndarray  # state * 257 + symbol -> state
    emit: np.ndarray  # likewise -> bits
    start: int

    @property
    def states(self) -> int:
        return len(self.step) // 257


def automaton(sentinels: tuple[bytes, ...], closers: bytes = b"\n") -> Automaton:
    """The table for these sentinels and units that end after any of the bytes `closers` (or with the text)."""
    prefixes = sorted({s[:i] for s in sentinels for i in range(len(s))} - {b""})
    names: list[tuple[str, object]] = [("fresh", 0), ("open", 0), ("due", 1), ("due", 2), ("due", 3), *(("read", p) for p in prefixes)]
    number = {n: i for i, n in enumerate(names)}
    step, emit = np.zeros((len(names), 257), np.uint8), np.zeros((len(names), 257), np.uint8)
    for (kind, what), i in number.items():
        for byte in range(256):
            continues = 0x80 <= byte < 0xC0
            due = what if kind == "due" else 0
            bits = 0 if continues and due else POINT
            read = (what if kind == "read" else b"") + bytes([byte])
            if any(read.endswith(s) for s in sentinels):
                bits |= SENTINEL
            while read and ("read", read) not in number:
                read = read[1:]
            if byte in closers:
                to, bits = ("fresh", 0), bits | UNIT
            elif read:
                to = ("read", read)
            elif continues and due > 1:
                to = ("due", due - 1)
            elif 0xC2 <= byte < 0xF5:
                to = ("due", 1 + (byte >= 0xE0) + (byte >= 0xF0))
            else:
                to = ("open", 0)
            step[i, byte], emit[i, byte] = number[to], bits
        step[i, END], emit[i, END] = number["fresh", 0], 0 if kind == "fresh" else UNIT
    return Automaton(step.ravel(), emit.ravel(), number["fresh", 0])


def transitions(table: Automaton, symbols: np.ndarray, lanes: int = 1024) -> np.ndarray:
    """What each transition of the stream emits, read in lanes."""
    width = -(-len(symbols) // max(1, min(lanes, len(symbols) // 16)))
    lanes = -(-len(symbols) // width)
    padded = np.full(lanes * width, END, np.uint16)
    padded[: len(symbols)] = symbols
    columns = np.ascontiguousarray(padded.reshape(lanes, width).T)
    # Where each lane leads from every state; once all states agree they are one.
    leads = np.repeat(np.arange(table.states, dtype=np.intp)[:, None], lanes, axis=1)
    for column in columns:
        leads = table.step[leads * 257 + column].astype(np.intp)
        if (leads == leads[0]).all() and len(leads) > 1:
            leads = leads[:1]
    state, begin = table.start, np.empty(lanes, np.intp)
    for i in range(lanes):
        begin[i] = state
        state = leads[state if len(leads) > 1 else 0, i]
    out = np.empty((width, lanes), np.uint8)
    for column, row in zip(columns, out):
        at = begin * 257 + column
        np.take(table.emit, at, out=row)
        begin = table.step[at].astype(np.intp)
    return out.T.ravel()[: len(symbols)]


def draws(seed: int, doc_id: int | None) -> tuple[int, ...]:
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def assembled(form: str, parts: tuple[bytes, bytes, bytes], sentinels: tuple[bytes, ...]) -> bytes:
    """The output of prefix, middle and suffix.  sentinels: of prefix, suffix, middle."""
    prefix, middle, suffix = parts
    p, s, m = sentinels
    if form == "psm":
        return b"".join((p, prefix, s, suffix, m, middle))
    if form == "spm":
        return b"".join((s, suffix, p, prefix, m, middle))
    return prefix + middle + suffix


def restored(form: str, output: bytes, sentinels: tuple[bytes, ...]) -> bytes:
    """The text that an output was made of."""
    p, s, m = sentinels
    if form == "plain":
        return output
    first, second = (p, s) if form == "psm" else (s, p)
    head, _, middle = output.removeprefix(first).partition(m)
    one, _, two = head.partition(second)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>"), seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, closers: bytes = b"\n", outputs: bool = True) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, restored_sha256, output_sha256 and (outputs) output of every row of docs (doc_id, text)."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"] + ["output"] * outputs
    marks = tuple(s.encode() for s in sentinels)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = automaton(marks, closers)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for slab in slabs(batch.column(1)):
                rows = list(_slab(slab, ids[slab.first : slab.first + len(slab)], table))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.string()] * outputs
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def _slab(slab, ids, table):
        ends = slab.offsets[1:]
        symbols = np.insert(slab.data.astype(np.uint16), ends, END)
        bits = transitions(table, symbols)
        close = slab.offsets + np.arange(len(slab) + 1)  # documents' bounds in the stream
        points, units, found = (np.concatenate([[0], np.cumsum((bits & b) != 0)]) for b in (POINT, UNIT, SENTINEL))
        at = np.flatnonzero(bits & UNIT)  # a document's last unit may end at its end symbol
        for i, doc_id in enumerate(ids):
            a, b = close[i], close[i + 1]
            n = int(units[b] - units[a])
            h1, h2, h3, h4 = draws(seed, doc_id)
            text = slab.text(i)
            if not text or found[b] > found[a] or h3 % 100 >= fim_percent:
                form, parts, chars = "plain", (text, b"", b""), (None, None)
            else:
                form = "spm" if h4 % 100 < spm_percent else "psm"
                cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
                x, y = (min(int(at[units[a] + c - 1]) + 1, int(b) - 1) if c else int(a) for c in cuts)
                parts = (text[: x - a], text[x - a : y - a], text[y - a :])
                chars = (int(points[x] - points[a]), int(points[y] - points[x]))
            output = assembled(form, parts, marks)
            again = restored(form, output, marks)
            row = (doc_id, n, form, *chars, hashlib.sha256(output).hexdigest(), hashlib.sha256(again).hexdigest())
            yield (*row, output.decode("utf-8", "replace")) if outputs else row

    kind = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * outputs
    return scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), transform, kind)
