"""Licence scan: Aho-Corasick for tags and notice phrases, shunting-yard for expressions.

A text is lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; one
automaton finds all phrases as whole words.  Where it finds ``spdx license identifier``, the
rest of that line is an expression of identifiers, ``and``, ``or``, ``with`` and brackets.
It is turned into reverse Polish by the shunting-yard method (with binds closest, then and,
then or) and evaluated to the freedom it grants: identifiers have a value from 0 to 1,
``and`` takes the least, ``or`` the most, ``with`` lifts the left side half-way to 1.  A
document's score joins all its notices and expressions by ``and``; without any it is 0.

Defined cases: null and empty texts have no words, no labels and score 0; an expression that
is not well-formed gives its labels but no value; texts of any length are scanned whole;
repeated rows are scanned each; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from plexor.llm.store import scan as batched
from plexor.llm.words import slabs

# Phrases and their labels; the first four are the base.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "boost software license": "bsl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
#: How free a licence leaves its users, 0 to 1.
FREEDOM = {"gpl": 0.3, "agpl": 0.2, "lgpl": 0.5, "apache": 0.9, "cc-by": 0.8, "cc0": 1.0, "mit": 1.0, "bsd": 0.95, "isc": 1.0, "mpl": 0.6, "epl": 0.55, "bsl": 0.95, "unlicense": 1.0, "reserved": 0.0}
#: What an identifier in an expression begins with, longest first.
PREFIXES = sorted([*FREEDOM, "0bsd", "cc-by", "cc0"], key=len, reverse=True)

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_RANK = {"or": 1, "and": 2, "with": 3}
_TOKENS = re.compile(r"[()]|[a-z0-9.+-]+")
_MARK = re.compile(r"spdx[^a-z0-9\n]*license[^a-z0-9\n]*identifier[\x20\t:]*([^\n]*)")


def label_of(identifier: str) -> str | None:
    return next(("bsd" if p == "0bsd" else p for p in PREFIXES if identifier.startswith(p)), None)


def reverse_polish(tokens: list[str]) -> list[str]:
    """Shunting-yard; ValueError if brackets or operands don't match."""
    out, held, operand = [], [], True
    for t in tokens:
        if t in _RANK:
            if operand:
                raise ValueError(f"{t} lacks its left side")
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[t]:
                out.append(held.pop())
            held.append(t)
            operand = True
        elif t == "(":
            if not operand:
                raise ValueError("bracket after an operand")
            held.append(t)
        elif t == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held or operand:
                raise ValueError("unmatched bracket")
            held.pop()
        else:
            if not operand:
                raise ValueError("two operands in a row")
            out.append(t)
            operand = False
    if operand or "(" in held:
        raise ValueError("unfinished expression")
    return out + held[::-1]


def evaluate(rpn: list[str]) -> tuple[float | None, set[str]]:
    """(freedom, labels); identifiers that are not known count as 0, exceptions carry no label."""
    stack: list[tuple[float, set[str]]] = []
    for t in rpn:
        if t not in _RANK:
            label = label_of(t)
            stack.append((FREEDOM.get(label, 0.0), {label} if label else set()))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        stack.append({"or": (max(a, b), left | right), "and": (min(a, b), left | right), "with": ((1 + a) / 2, left)}[t])
    return stack[0]


def expression(text: str) -> tuple[float | None, set[str]]:
    """Freedom and labels of the expression that a line begins with; no freedom if there is none.

    A full stop ends the line's last identifier, and words after a complete expression end it.
    """
    tokens = []
    for t in _TOKENS.findall(text):
        t = t.strip(".-") or t
        if t not in _RANK and t not in "()" and tokens and (tokens[-1] == ")" or tokens[-1] not in _RANK and tokens[-1] != "("):
            break
        tokens.append(t)
    while tokens and tokens[-1] in _RANK:
        tokens.pop()
    try:
        return evaluate(reverse_polish(tokens))
    except ValueError:
        return None, {x for x in map(label_of, tokens) if x}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in {**BASE, **MORE, TAG: "tag"}.items():
        found.add_word(f" {phrase} ", (phrase, label))
    found.make_automaton()
    return found


def scan_text(raw: bytes, finder: ahocorasick.Automaton) -> tuple[int, int, int | None, int | None, set[str], set[str], float]:
    """n_words, n_base, first_word, last_word, base labels, labels, score."""
    words = raw.translate(_WORDS).split()
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    starts, base, labels, values, tagged = [], set(), set(), [], False
    seen, place = 0, -1  # spaces in the first `seen` characters, counted once for all matches
    for end, (phrase, label) in finder.iter(line):
        if phrase in BASE:
            at = end - len(phrase)  # matches are in the order of their ends, so a start may be before the last one
            place += line.count(" ", seen, at) if at >= seen else -line.count(" ", at, seen)
            seen = at
            starts.append(place)
            base.add(label)
        if label == "tag":
            tagged = True
        else:
            labels.add(label)
            values.append(FREEDOM[label])
    if tagged:
        for m in _MARK.finditer(raw.lower().decode('utf-8', 'replace')):
            value, names = expression(m[1])
            labels |= names
            values += [] if value is None else [value]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), base, labels, min(values, default=0.0)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame) -> DataFrame:
    """SCHEMA for every row of docs (doc_id, text); words are numbered from 0, labels sorted and comma-joined."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            rows = [scan_text(slab.text(i), finder) for slab in slabs(batch.column(1)) for i in range(len(slab))]
            columns = [*zip(*((*r[:4], ",".join(sorted(r[4])), ",".join(sorted(r[5])), r[6]) for r in rows))] or [()] * 7
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, map(list, columns), kinds)], names)

    return batched(docs.select("doc_id", "text"), scan, SCHEMA)
