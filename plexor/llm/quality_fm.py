"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document's features are its words hashed into 2^16 buckets (weights log(1 + count), scaled
to unit length), twelve structure statistics in bins, and any `metadata` columns the caller
names, hashed together with their column's name.  The score is
``sigmoid(w0 + sum w_j x_j + sum_{i<j} <v_i, v_j> x_i x_j)``; the pairwise part is computed in
linear time as half of ``|sum v_j x_j|^2 - sum |v_j|^2 x_j^2``.

It is trained on the driver by AdaGrad, with about `updates` updates, on at most `sample` labelled rows, picked by a hash of
the id (a documented bound; the model is two arrays of 2^16 x (1 + rank) numbers).  Every
document is then scored, whole.

Defined cases: null and empty texts have no words and are scored by their structure; without
labels of both kinds the score is the share of label 1 (0.5 without any label); conflicting
labels of one document all count; null metadata is a value of its own; repeated rows are
scored each and alike, as are equal texts; an empty table gives an empty result; texts of
any length are read whole; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexor.llm.store import scan as batched
from plexor.llm.words import Slab, mix, slabs

WORDS = 1 << 16
STATS = 12
BINS = 16
META = 1 << 10
WIDTH = WORDS + STATS * BINS + META

_CLASSES = {
    "letters": [*range(65, 91), *range(97, 123), *range(128, 256)],
    "capitals": range(65, 91),
    "digits": range(48, 58),
    "symbols": b"#*$%&|<>",
    "marks": b"!?",
    "stops": b".,;:",
    "lines": [10],
    "spaces": [9, 10, 11, 12, 13, 32],
}
_FLAGS = {}
for _name, _bytes in _CLASSES.items():
    _FLAGS[_name] = np.zeros(256, bool)
    _FLAGS[_name][list(_bytes)] = True


def structure(slab: Slab, n_words: np.ndarray, n_distinct: np.ndarray) -> np.ndarray:
    """Bin numbers (documents x STATS) of the structure statistics."""
    size = np.diff(slab.offsets)
    count = {k: slab.counted(f[slab.data]) for k, f in _FLAGS.items()}
    some, words = np.maximum(size, 1), np.maximum(n_words, 1)
    shares = [count[k] / some for k in ("letters", "capitals", "digits", "symbols", "marks", "stops", "spaces")]
    shares += [n_distinct / words, count["lines"] / words]
    sizes = [np.log2(1 + size) / 20, np.log2(1 + n_words) / 16, np.log2(1 + size / words) / 6]
    # Small shares matter, so shares are binned on a square-root scale.
    return np.stack([np.minimum((np.sqrt(s) * BINS).astype(int), BINS - 1) for s in shares] + [np.minimum((s * BINS).astype(int), BINS - 1) for s in sizes], axis=1)


def features(slab: Slab, meta: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, values, bounds by document) of the sparse rows."""
    slab.prepare(lower=True)
    starts, ends, bounds = slab.words()
    bucket = (mix(slab.hashes(starts, ends)) & np.uint64(WORDS - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(slab)), np.diff(bounds))
    pair, times = np.unique(doc * WORDS + bucket, return_counts=True)
    doc, bucket = pair // WORDS, pair % WORDS
    value = np.log1p(times)
    value /= np.sqrt(np.bincount(doc, value**2, len(slab)))[doc]
    stats = WORDS + np.arange(STATS) * BINS + structure(slab, np.diff(bounds), np.bincount(doc, minlength=len(slab)))
    dense = stats if meta is None else np.hstack([stats, WORDS + STATS * BINS + meta[slab.first : slab.first + len(slab)]])
    columns = np.concatenate([bucket, dense.ravel()])
    values = np.concatenate([value, np.full(dense.size, dense.shape[1] ** -0.5)])
    rows = np.concatenate([doc, np.repeat(np.arange(len(slab)), dense.shape[1])])
    order = np.argsort(rows, kind="stable")
    return columns[order], values[order], np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(slab)))])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, columns: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Linear time in the number of features: no pair is ever formed.  Every row has a feature."""
        own = self.factors[columns] * values[:, None]
        total = np.add.reduceat(own, bounds[:-1], axis=0)
        squares = np.add.reduceat((own**2).sum(axis=1), bounds[:-1])
        return self.bias + np.add.reduceat(self.linear[columns] * values, bounds[:-1]) + 0.5 * ((total**2).sum(axis=1) - squares)


def learn(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rank: int, epochs: int, rate: float, decay: float, seed: int) -> Machine:
    """AdaGrad on the logistic loss; classes weigh alike."""
    rng = np.random.default_rng(seed)
    share = y.mean() if len(y) else 0.5
    m = Machine(0.0, np.zeros(WIDTH), rng.normal(0, 0.01, (WIDTH, rank)))
    if share in (0, 1) or not len(y):
        m.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        m.factors[:] = 0
        return m
    m.bias = float(np.log(share / (1 - share)))
    g_linear, g_factors, g_bias = np.full(WIDTH, 1e-6), np.full((WIDTH, rank), 1e-6), 1e-6
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            c, x = rows[i]
            own = m.factors[c] * x[:, None]
            total = own.sum(axis=0)
            z = m.bias + m.linear[c] @ x + 0.5 * (total @ total - (own**2).sum())
            slope = (1 / (1 + np.exp(-z)) - y[i]) * weight[i]
            d_linear = slope * x + decay * m.linear[c]
            d_factors = slope * x[:, None] * (total - own) + decay * m.factors[c]
            g_linear[c] += d_linear**2
            g_factors[c] += d_factors**2
            g_bias += slope**2
            m.linear[c] -= rate * d_linear / np.sqrt(g_linear[c])
            m.factors[c] -= rate * d_factors / np.sqrt(g_factors[c])
            m.bias -= rate * slope / np.sqrt(g_bias)
    return m


def _meta(columns: list[pa.Array], names: list[str]) -> np.ndarray | None:
    if not names:
        return None
    return np.stack([(pd.util.hash_array(np.array([f"{n}={v}" for v in c.to_pylist()], object)) % META).astype(np.int64) for n, c in zip(names, columns)], axis=1)


def train(docs: DataFrame, labels: DataFrame, metadata: list[str] = (), sample: int = 6000, rank: int = 8, updates: int = 18_000, rate: float = 0.05, decay: float = 1e-5, seed: int = 11) -> Machine:
    """labels: doc_id, y (0 or 1)."""
    picked = labels.where("doc_id is not null and y is not null").select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    first = docs.where("doc_id is not null").select("doc_id", "text", *metadata).join(F.broadcast(picked.select("doc_id").distinct()), "doc_id")
    once = first.groupBy("doc_id").agg(F.min(F.struct("text", *metadata)).alias("first")).select("doc_id", "first.*")  # a document listed more than once counts as one
    chosen = once.join(F.broadcast(picked), "doc_id")  # at most `sample` rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta = _meta([batch.column(2 + i) for i in range(len(metadata))], list(metadata))
            rows = []
            for slab in slabs(batch.column(1)):
                c, x, at = features(slab, meta)
                rows += [(c[at[i] : at[i + 1]].astype(np.int32).tobytes(), x[at[i] : at[i + 1]].astype(np.float32).tobytes()) for i in range(len(slab))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.num_columns - 1), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "y", "c", "x"])

    kept = batched(chosen.select("doc_id", "text", *metadata, F.col("y").cast("int").alias("y")), extract, "doc_id long, y int, c binary, x binary")
    got = sorted((r["doc_id"], r["y"], bytes(r["c"]), bytes(r["x"])) for r in kept.toLocalIterator())
    rows = [(np.frombuffer(c, np.int32), np.frombuffer(x, np.float32)) for _, _, c, x in got]
    return learn(rows, np.array([y for _, y, _, _ in got], float), rank, max(1, updates // max(1, len(got))), rate, decay, seed)


def score(docs: DataFrame, machine: Machine, metadata: list[str] = ()) -> DataFrame:
    """doc_id, score of every row of docs."""
    used = np.flatnonzero(machine.linear)
    small = (machine.bias, used.astype(np.int32), machine.linear[used].astype(np.float32), machine.factors[used].astype(np.float32))
    rank = machine.factors.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, at, linear, factors = small  # what no labelled row had is left out, and counts as 0
        m = Machine(bias, np.zeros(WIDTH, np.float32), np.zeros((WIDTH, rank), np.float32))
        m.linear[at], m.factors[at] = linear, factors
        for batch in batches:
            meta = _meta([batch.column(2 + i) for i in range(len(metadata))], list(metadata))
            z = [m.margins(*features(slab, meta)) for slab in slabs(batch.column(1))]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(z) if z else np.zeros(0), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    return batched(docs.select("doc_id", "text", *metadata), scan, "doc_id long, score double")
