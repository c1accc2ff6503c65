"""Secret scan: patterns, and Markov models of characters for what no pattern names.

Two first-order character models, one of random strings and one of ordinary identifiers,
are trained from labelled samples with add-half smoothing.  The random samples are drawn; the
ordinary ones are joined of words that a chain draws, whose letters are counted in the words of
all documents, so every language and source of the corpus has its share.  Every run of 20 or
more characters of ``[A-Za-z0-9+/_=-]``, less what the patterns have found of it, is scored by
the log-likelihood ratio per character; above `threshold` it is a span of kind ``random``.
Base spans of the patterns always stay.

Defined cases: null and empty texts have no spans; offsets are code points; texts of any
length are scanned whole; repeated rows are scanned each; an empty table gives an empty
result (and models of the samples that need no documents: ten fixed words); further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexor.llm.store import scan as batched
from plexor.llm.words import Slab, mix, slabs

# The base patterns and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_INDEX = {c: i for i, c in enumerate(ALPHABET)}


class CharModel:
    """log P of a string, first character then each one given the one before.

    more: (first, pairs) counted elsewhere; they weigh as much as the samples together.
    """

    def __init__(self, samples: Iterable[str], more: tuple[np.ndarray, np.ndarray] | None = None):
        n = len(ALPHABET)
        first, pairs = np.zeros(n), np.zeros((n, n))
        for s in samples:
            at = [_INDEX[c] for c in s if c in _INDEX]
            if at:
                first[at[0]] += 1
                np.add.at(pairs, (at[:-1], at[1:]), 1)
        if more is not None and more[1].sum() > 0:
            first += more[0] * (first.sum() / max(more[0].sum(), 1))
            pairs += more[1] * (pairs.sum() / more[1].sum())
        first, pairs = first + 0.5, pairs + 0.5
        self.first, self.pairs = np.log(first / first.sum()), np.log(pairs / pairs.sum(axis=1, keepdims=True))

    def __call__(self, s: str) -> float:
        at = [_INDEX[c] for c in s]
        return float(self.first[at[0]] + self.pairs[at[:-1], at[1:]].sum())


def random_strings(n: int, seed: int = 7) -> list[str]:
    """Labelled samples of the random class: hexadecimal, base-62 and base-64 keys of 20 to 64 characters."""
    rng = random.Random(seed)
    kinds = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64] + "-_")
    return ["".join(rng.choices(kinds[i % 3], k=rng.randint(20, 64))) for i in range(n)]


def identifiers(words: list[str], n: int, seed: int = 7) -> list[str]:
    """Labelled samples of the ordinary class: words, and words joined as snake_case, kebab-case, paths, CamelCase or with a number."""
    rng, out = random.Random(seed), []
    for i in range(n if words else 0):
        some = rng.choices(words, k=rng.randint(1, 4))
        joined = ("_".join(some), "-".join(some), "/".join(some), "".join(w[:1].upper() + w[1:] for w in some), "".join(some), "_".join(some).upper() + "_" + str(rng.randint(0, 2030)))
        out.append(joined[i % 6])
    return out


#: Words whose letters count: runs of letters alone, of 2 to LONGEST, with no letter, digit or other byte of a word's beside them.
LONGEST = 24
_LETTER = np.full(256, -1)
_LETTER[[ord(c) for c in ALPHABET[:52]]] = np.arange(52)
_WORD = np.zeros(256, bool)
_WORD[[ord(c) for c in ALPHABET[:62]]] = True
_WORD[128:] = True
_CELLS = LONGEST + 1 + 52 + 52 * 52


def _letters(slab: Slab) -> np.ndarray:
    """Counts of words by length, of first letters, and of letters after letters; a document's word counts once, however often it comes."""
    word, letter = _WORD[slab.data], _LETTER[slab.data]
    breaks = np.unique(np.concatenate([np.flatnonzero(~word), np.flatnonzero(~word) + 1, slab.offsets]))
    starts, sizes = breaks[:-1], np.diff(breaks)
    other = np.zeros(len(word) + 1, np.int64)
    np.cumsum(letter < 0, out=other[1:])
    kept = (sizes >= 2) & (sizes <= LONGEST) & (other[starts + sizes] == other[starts])
    starts, sizes = starts[kept], sizes[kept]
    slab.prepare(lower=False)
    owner = np.searchsorted(slab.offsets, starts, "right").astype(np.uint64)
    once = np.unique(mix(slab.hashes(starts, starts + sizes) + mix(owner)), return_index=True)[1]
    starts, sizes = starts[once], sizes[once]
    at = np.repeat(starts, sizes - 1) + np.arange((sizes - 1).sum()) - np.repeat(np.cumsum(sizes - 1) - (sizes - 1), sizes - 1)
    return np.concatenate([np.bincount(sizes, minlength=LONGEST + 1), np.bincount(letter[starts], minlength=52), np.bincount(letter[at] * 52 + letter[at + 1], minlength=52 * 52)])


def letter_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words by length, first letters, letters after letters) of the words of all documents; _CELLS numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(_CELLS, np.int64)
        for batch in batches:
            for slab in slabs(batch.column(0)):
                sums += _letters(slab)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["cell", "n"])

    out = np.zeros(_CELLS, np.int64)
    for r in batched(docs.select("text"), count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out[: LONGEST + 1], out[LONGEST + 1 : LONGEST + 53], out[LONGEST + 53 :].reshape(52, 52)


def drawn_words(counts: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, seed: int = 7) -> list[str]:
    """Words of a chain with these counts; none where nothing was counted."""
    sizes, first, pairs = counts
    if not sizes.sum():
        return []
    rng = np.random.default_rng(seed)
    lengths = rng.choice(len(sizes), n, p=sizes / sizes.sum())
    at = rng.choice(52, n, p=first / first.sum())
    chains = [at]
    steps = np.cumsum(pairs + 1e-9, axis=1)
    steps /= steps[:, -1:]
    for _ in range(lengths.max() - 1):
        at = np.minimum((rng.random(n)[:, None] > steps[at]).sum(axis=1), 51)
        chains.append(at)
    return ["".join(ALPHABET[chains[j][i]] for j in range(lengths[i])) for i in range(n)]


def train(docs: DataFrame, samples: int = 20_000) -> tuple[CharModel, CharModel]:
    """(random, ordinary) models; letters are counted in all documents, samples is the number of strings drawn for each class."""
    counts = letter_counts(docs)
    words = ["user", "name", "value", "index", "config", "version", "document", "request", "handler", "default", *drawn_words(counts, 2000)]
    n = len(ALPHABET)
    first, pairs = np.zeros(n), np.zeros((n, n))
    first[:52], pairs[:52, :52] = counts[1], counts[2]
    return CharModel(random_strings(samples)), CharModel(identifiers(words, samples), (first, pairs))


def base_spans(text: str, low: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns."""
    out = []
    if low is None or any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if low is None or b"akia" in low:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def more_spans(text: str, base: list[tuple[int, int, int]], models: tuple[CharModel, CharModel], threshold: float) -> list[tuple[int, int, int]]:
    """Candidates, or what base spans leave of them, that look random."""
    out = []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        for a, _, b in [x for x in base if x[0] < e and s < x[2]] + [(e, 0, e)]:
            piece = text[s:a]
            if len(piece) >= 20 and not piece.isdigit() and models[0](piece) - models[1](piece) > threshold * len(piece):
                out.append((s, 3, a))
            s = max(s, b)
    return out


#: Which bytes may belong to a candidate, as a table of flags.
_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in ALPHABET]] = True


def _long_runs(slab: Slab, length: int) -> np.ndarray:
    """Of each document: has it `length` candidate bytes in a row?  Every hex and access span is such a run."""
    ok = _RUN[slab.data]
    breaks = np.flatnonzero(~ok)
    edges = np.unique(np.concatenate([breaks, slab.offsets]))
    long = edges[:-1][np.diff(edges) >= length]
    out = np.zeros(len(slab), bool)
    out[np.searchsorted(slab.offsets, long, "right") - 1] = True
    return out


def secret_scan(docs: DataFrame, models: tuple[CharModel, CharModel], threshold: float = 0.5) -> DataFrame:
    """doc_id, spans (array of kind, start, end, in order) of every row of docs (doc_id, text)."""
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for slab in slabs(batch.column(1)):
                runs = _long_runs(slab, 20)
                for i in range(len(slab)):
                    raw = slab.text(i)
                    low = raw.lower()
                    named = any(w in low for w in WORDS)
                    if not named and not runs[i]:
                        out.append([])
                        continue
                    text = raw.decode("utf-8", "replace")
                    base = base_spans(text, low)
                    found = sorted(base + (more_spans(text, base, models, threshold) if runs[i] else []))
                    out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, spans_type)], ["doc_id", "spans"])

    return batched(docs.select("doc_id", "text"), scan, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and strings of the spans."""
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.array_join(F.transform(F.filter("spans", lambda x: x["kind"] != "random"), shown), ",")
    return scanned.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
    )
