"""Quality rules: counts by fixed rules, then a hashed n-gram log-likelihood ratio.

Words and word pairs (A-Z lower-cased) are hashed into 2^16 buckets.  Two multinomials are
counted over every document: one of the trusted target (documents whose label says
quality 1), one of the raw corpus.  A document's score is the mean over its n-grams of
log P(target) - log P(raw); the mean is the length normalisation.  The threshold lies
`margin` below the score that all but one in `tail` of the trusted documents reach, read
from a histogram of scores, so it depends on the tables alone and every run decides alike.

Counts leave each task as 64 slices of an array and are summed slice by slice, which is as
much for a task of any size; the model (two arrays of 2^16 numbers) is bounded.

Defined cases: null and empty texts have no words and fail the base rules; without any
trusted document the base rules decide alone; a document labelled more than once is trusted
if one label says so; texts of any length are read whole; repeated rows count and are judged
each; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexor.llm.store import Store, with_ids
from plexor.llm.store import scan as batched
from plexor.llm.words import Slab, mix, slabs, windows

BUCKETS = 1 << 16
SLICES = 64

# What the base rules count as symbols.
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POINT = np.array([b & 0xC0 != 0x80 for b in range(256)])


def grams(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and of pairs, each with the documents' bounds."""
    pairs, pair_bounds = windows(words, bounds, 2, short=False)
    mask = np.uint64(BUCKETS - 1)
    return (mix(words) & mask).astype(np.int64), bounds, (pairs & mask).astype(np.int64), pair_bounds


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=run[1:])
    return run[bounds[1:]] - run[bounds[:-1]]


def _repeat_words(w: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each document, the words in 5-word windows that the document has twice or more."""
    h, at = windows(w, bounds, 5, short=False)
    out = np.zeros(len(bounds) - 1, np.int64)
    for i in range(len(out)):
        own = h[at[i] : at[i + 1]]
        if len(own) < 2:
            continue
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        if same.any():
            cover = np.zeros(len(own) + 5, np.int64)
            twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
            np.add.at(cover, twice, 1)
            np.add.at(cover, twice + 5, -1)
            out[i] = np.count_nonzero(np.cumsum(cover)[:-1])
    return out


def _dup_lines(slab: Slab) -> np.ndarray:
    """Of each document, the lines with a word that equal an earlier line."""
    inner = np.flatnonzero(slab.data == 10)
    starts = np.unique(np.concatenate([slab.offsets[:-1], inner + 1]))  # a final newline of one document is the start of the next
    doc = np.searchsorted(slab.offsets, starts, "right") - 1
    ok = doc < len(slab)
    starts, doc = starts[ok], doc[ok]
    next_break = np.append(inner, len(slab.data))
    ends = np.minimum(next_break[np.searchsorted(inner, starts)], slab.offsets[doc + 1])
    run = np.zeros(len(slab.data) + 1, np.int64)
    np.cumsum(~_SPACE[slab.data], out=run[1:])
    full = run[ends] > run[starts]
    h, doc = slab.hashes(starts[full], ends[full]), doc[full]
    order = np.lexsort((h, doc))
    same = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    return np.bincount(doc[order[1:]][same], minlength=len(slab)).astype(np.int64)


def fit(spark: SparkSession, docs: DataFrame, trusted: DataFrame, store: Store) -> np.ndarray | None:
    """log P(target) - log P(raw) of each bucket, or None without trusted documents."""
    marked = with_ids(docs.select("doc_id", "text"), trusted, ["doc_id"], "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            chosen = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for slab in slabs(batch.column(0)):
                slab.prepare(lower=True)
                starts, ends, bounds = slab.words()
                for g, at in zip(*[iter(grams(slab.hashes(starts, ends), bounds))] * 2):
                    inside = np.repeat(chosen[slab.first : slab.first + len(slab)], np.diff(at))
                    total[0] += np.bincount(g, minlength=BUCKETS)
                    total[1] += np.bincount(g[inside], minlength=BUCKETS)
        yield from sliced(total)

    def sliced(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = np.split(total, SLICES, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.ravel() for p in parts], pa.list_(pa.int64()))], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = counts.values.to_numpy()
                sums[k] = sums[k] + own if k in sums else own.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["slice", "counts"])

    kind = "slice int, counts array<long>"
    counted = batched(marked, count, kind).repartition(SLICES, "slice").mapInArrow(add, kind)
    total = np.zeros((2, BUCKETS))
    for r in store.put(counted, "counts").collect():  # SLICES rows, BUCKETS * 2 numbers in all
        width = BUCKETS // SLICES
        total[:, r["slice"] * width : (r["slice"] + 1) * width] += np.array(r["counts"], float).reshape(2, width)
    if not total[1].any():
        return None
    log_p = np.log((total + 1) / (total.sum(axis=1, keepdims=True) + BUCKETS))
    return log_p[1] - log_p[0]


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def _measured(column: pa.Array, table: np.ndarray) -> list[pa.Array]:
    """SCHEMA without doc_id of a column of texts."""
    parts: list[list[np.ndarray]] = [[] for _ in range(6)]
    for slab in slabs(column):
        slab.prepare(lower=False)
        starts, ends, bounds = slab.words()
        w = slab.hashes(starts, ends)
        n = np.diff(bounds)
        rules = [n, slab.counted(_POINT[slab.data] & ~_SPACE[slab.data]), slab.counted(_SYMBOL[slab.data]), _dup_lines(slab), _repeat_words(w, bounds)]
        slab.prepare(lower=True)
        g1, b1, g2, b2 = grams(slab.hashes(starts, ends), bounds)
        score = (_sums(table[g1], b1) + _sums(table[g2], b2)) / np.maximum(np.diff(b1) + np.diff(b2), 1)
        for have, new in zip(parts, [*rules, score]):
            have.append(new)
    kinds = [pa.int64()] * 5 + [pa.float64()]
    return [pa.array(np.concatenate(p) if p else [], k) for p, k in zip(parts, kinds)]


def measure(docs: DataFrame, ratio: np.ndarray | None) -> DataFrame:
    """SCHEMA for every row of docs (doc_id, text)."""
    table = np.zeros(BUCKETS) if ratio is None else ratio

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_measured(batch.column(1), table)], [x.split()[0] for x in SCHEMA.split(", ")])

    return batched(docs.select("doc_id", "text"), scan, SCHEMA)


#: Width of the histogram of scores.
STEP = 1 / 1024


def _base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def decide(spark: SparkSession, docs: DataFrame, labels: DataFrame, tail: int, margin: float) -> tuple[np.ndarray | None, float, DataFrame]:
    """(the model, the threshold, the measured documents as a written table)."""
    store = Store(spark, "quality-rules")
    trusted = store.put(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(True)), "trusted")
    ratio = fit(spark, docs, trusted, store)
    measured = store.put(measure(docs, ratio), "measured")
    if ratio is None:
        return ratio, -float("inf"), measured
    step = F.floor(F.col("score") / STEP)
    passed = with_ids(measured.where(~_base_failed()), trusted, ["doc_id"])
    steps = passed.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy("step").collect()  # as many rows as steps
    seen, most = 0, sum(r["n"] for r in steps) / tail
    for r in steps:
        seen += r["n"]
        if seen > most:
            return ratio, r["step"] * STEP - margin, measured
    return ratio, -float("inf"), measured


def quality_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, tail: int = 1000, margin: float = 0.06) -> DataFrame:
    """doc_id, the counts, score, base_failed and kept of every row of docs (doc_id, text)."""
    _, threshold, measured = decide(spark, docs, labels, tail, margin)
    return measured.select("*", _base_failed().alias("base_failed"), (~_base_failed() & (F.col("score") >= threshold)).alias("kept"))


def kept_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, tail: int = 1000, margin: float = 0.06) -> DataFrame:
    """The rows of docs that quality_rules() keeps, whatever their ids; all columns stay."""
    ratio, threshold, _ = decide(spark, docs, labels, tail, margin)
    table = np.zeros(BUCKETS) if ratio is None else ratio
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, _, _, _, repeated, score = (x.to_numpy() for x in _measured(batch.column(at), table))
            yield batch.filter(pa.array((n >= 10) & (100 * repeated <= 20 * n) & (score >= threshold)))

    return batched(docs, keep, docs.schema)
