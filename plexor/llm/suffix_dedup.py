"""Removal of repeated byte strings by suffix arrays over the whole corpus.

A byte goes if it is covered by a string of `length` bytes that also starts in a document with a
smaller doc_id.  Texts are UTF-8 bytes; strings never cross documents and are judged on the input.

1. Equal texts are one (by SHA-256): all but the one with the smallest doc_id go whole, if long
   enough.  The others are dealt by hash into parts of about PART bytes.
2. Screen.  Each string of `length` bytes has an anchor: of the GRAM-byte grams in it (all but SPREAD
   bytes) that of the smallest hash.  Equal strings have equal anchors, so only strings around anchors
   that several documents have can repeat.  A part sends each anchor's hash once; owners of hash
   ranges answer which are shared.
3. Suffix arrays.  A shared anchor's surroundings, the bytes of all strings that it can be the anchor
   of, go to the owner of its hash.  Owners put the suffixes of what came to them in order by
   two-stage sorting (`suffixes`): only those smaller than their successors are sorted directly, the
   others are induced by bucket scans.  Neighbours with a common prefix of `length` bytes are equal
   strings; of each such run the smallest doc_id is what the others are compared with.
4. Hot anchors, of more than HOT surroundings, would be one key.  For these a part makes the suffix
   array of its own strings first, and sends one string of each run, with the smallest doc_id, to the
   owner of the hash of the whole string: a string that all documents share is one row a part.
5. Answers come back to the parts, which mark and count bytes.

Bytes decide every match; hashes only say where strings meet.

Defined cases: null and empty texts have no bytes; a text shorter than `length` is left as it is; rows
without an id are neither compared nor changed; documents of the same id do not remove one another,
and repeated rows get the same answer; a text of any length is read whole; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexor.llm.store import Store, spread_join, with_ids
from plexor.llm.suffixes import common_prefixes, suffix_order, words_at
from plexor.llm.words import SLAB, Slab

#: Bytes of texts that a task handles at once; some 100 bytes of arrays for each.
PART = 1 << 20
#: Parts that an owner of anchors, and one of their surroundings, stands for.
ANCHORS_OF, AROUND_OF = 8, 4
#: Strings that have an anchor in common begin at one of so many places around it.
SPREAD = 31
#: Bytes of surroundings whose suffixes are put in order at once.
CHUNK = 1 << 18
#: Surroundings of one anchor that an owner takes; there are about 100 bytes in each.
HOT = 20_000


def extremes(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each run of `width` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def anchors_of(slab: Slab, length: int) -> tuple[np.ndarray, np.ndarray]:
    gram, n = length - SPREAD + 1, len(slab.data)
    slab.prepare(lower=False)
    starts = np.arange(n - gram + 1)
    h = slab.hashes(starts, starts + gram) | np.uint64(1)
    least = extremes(h, SPREAD, np.minimum)
    for end in slab.offsets[1:-1]:  # strings over the end of a document are none
        least[max(0, end - length + 1) : end] = 0
    edge = np.zeros(SPREAD - 1, np.uint64)
    at = np.flatnonzero(extremes(np.concatenate([edge, least, edge]), SPREAD, np.maximum) == h)
    return at, h[at]


@dataclass
class Part:
    """The distinct documents of a part, in order, as one buffer."""

    ids: np.ndarray
    raws: np.ndarray
    slab: Slab

    @classmethod
    def of(cls, table: pa.Table) -> Part:
        rows = sorted(set(zip(table["doc_id"].to_pylist(), table["raw"].to_pylist(), table["text"].to_pylist())))
        texts = [t.encode() for *_, t in rows]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        return cls(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), Slab(0, np.frombuffer(b"".join(texts), np.uint8), offsets))

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the anchors of all strings of `length` bytes."""
        offsets, places, hashes, i = self.slab.offsets, [], [], 0
        while i < len(self.ids):  # some documents at a time, which caches hold
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLAB, "right")) - 1)
            some = Slab(i, self.slab.data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            at, h = anchors_of(some, length)
            places.append(at + offsets[i])
            hashes.append(h)
            i = j
        return np.concatenate(places), np.concatenate(hashes)

    def around(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, documents) of the surroundings of anchors."""
        doc = np.searchsorted(self.slab.offsets, at, "right") - 1
        return np.maximum(self.slab.offsets[doc], at - SPREAD + 1), np.minimum(self.slab.offsets[doc + 1], at + length), doc

    def own_runs(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in suffix order, where each run of equal strings begins among them, documents) of the strings around anchors."""
        starts, ends, _ = self.around(at, length)
        cover = np.zeros(len(self.slab.data) + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, ends - length + 1, -1)
        words = words_at(self.slab.data)
        order = suffix_order(self.slab.data, np.cumsum(cover[:-1]) > 0, words)
        head = np.flatnonzero(common_prefixes(words, order, length) < length)
        return order, head, np.searchsorted(self.slab.offsets, order, "right") - 1


def bucket_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def rest_of(h: np.ndarray, bits: int) -> np.ndarray:
    """The 16 bits after those that name a bucket."""
    return ((h << np.uint64(bits)) >> np.uint64(48)).astype(np.uint16)


def cuts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]]) if len(sorted_keys) else np.zeros(1, np.int64)


def numbers(table: pa.Table, name: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table[name].to_pylist()]


def made(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


SENT = "bucket long, part long, grams binary, codes binary"
SHARED = "part long, grams binary, hot binary"
AROUND = "bucket long, part long, places binary, sizes binary, rests binary, ids binary, bytes binary, hot binary"
FOUND = "part long, places binary, masks binary, hot binary"


def screened(length: int, bits: int):
    def screen(table: pa.Table) -> pa.Table:
        part = Part.of(table)
        at, h = part.anchors(length)
        doc = np.searchsorted(part.slab.offsets, at, "right") - 1
        order = np.argsort(h, kind="stable")  # places stay in order, and so do documents
        h, doc = h[order], doc[order]
        edge = cuts(h)
        count = np.diff(edge)
        several = doc[edge[:-1]] != doc[edge[1:] - 1] if len(h) else np.zeros(0, bool)
        # A count by its logarithm, in steps of a quarter, and whether several documents have the anchor.
        code = (np.minimum(127, np.ceil(4 * np.log2(np.maximum(count, 1)))).astype(np.uint8) << 1) | several
        grams = h[edge[:-1]]
        bucket = bucket_of(grams, bits)
        at = cuts(bucket)
        own = table["part"][0].as_py()
        return made(SENT, [(int(bucket[i]), own, grams[i:j].tobytes(), code[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])])

    return screen


def answered(hot: int):
    def answer(table: pa.Table) -> pa.Table:
        grams, codes = numbers(table, "grams", "<u8"), numbers(table, "codes", "u1")
        _, back, parts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        code = np.concatenate(codes)
        several = np.bincount(back, code & 1, len(parts)) > 0
        held = np.bincount(back, 2.0 ** ((code >> 1) / 4), len(parts))
        shared, heavy = (several | (parts > 1))[back], (held > hot)[back]
        ends = np.cumsum([len(g) for g in grams])
        rows = []
        for part, g, stop in zip(table["part"].to_pylist(), grams, ends):
            own = slice(stop - len(g), stop)
            if shared[own].any():
                rows.append((part, g[shared[own] & ~heavy[own]].tobytes(), g[shared[own] & heavy[own]].tobytes()))
        return made(SHARED, rows)

    return answer


def members(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of h are among the sorted numbers `of`."""
    if not len(of):
        return np.zeros(len(h), bool)
    return of[np.minimum(np.searchsorted(of, h), len(of) - 1)] == h


def surroundings(length: int, bits: int):
    def send(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not len(shared) or not len(table):
            return made(AROUND, [])
        part = Part.of(table)
        plain, hot = (np.sort(np.concatenate(numbers(shared, name, "<u8"))) for name in ("grams", "hot"))
        at, h = part.anchors(length)
        few = members(h, plain)
        starts, ends, doc = part.around(at[few], length)
        key = h[few]
        if len(hot):
            order, head, docs = part.own_runs(at[members(h, hot)], length)
            leader = np.minimum.reduceat(part.ids[docs], head)
            first = order[head + _first(part.ids[docs] == np.repeat(leader, np.diff(np.append(head, len(order)))), head)]
            starts, ends = np.concatenate([starts, first]), np.concatenate([ends, first + length])
            doc = np.concatenate([doc, np.searchsorted(part.slab.offsets, first, "right") - 1])
            part.slab.prepare(lower=False)
            key = np.concatenate([key, part.slab.hashes(first, first + length)])
        by = np.argsort(key)
        starts, ends, doc, key = starts[by], ends[by], doc[by], key[by]
        sizes = ends - starts
        bucket = bucket_of(key, bits)
        edge, own, rows = cuts(bucket), table["part"][0].as_py(), []
        for i, j in zip(edge[:-1], edge[1:]):
            within = np.arange(sizes[i:j].sum()) - np.repeat(np.cumsum(sizes[i:j]) - sizes[i:j], sizes[i:j])
            content = part.slab.data[np.repeat(starts[i:j], sizes[i:j]) + within]
            rows.append((int(bucket[i]), own, starts[i:j].tobytes(), sizes[i:j].astype("u1").tobytes(), rest_of(key[i:j], bits).tobytes(), part.ids[doc[i:j]].tobytes(), content.tobytes(), None))
        if len(hot):
            rows.append((0, own, b"", b"", b"", b"", b"", hot.tobytes()))
        return made(AROUND, rows)

    return send


def _first(mask: np.ndarray, head: np.ndarray) -> np.ndarray:
    """How far after each head the first marked place is."""
    at = np.flatnonzero(mask)
    return at[np.searchsorted(at, head)] - head


def repeated(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """By bits, which strings of each surrounding also start in one with a smaller id; data holds the surroundings one after another."""
    room = sizes - length + 1
    rel = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
    wanted = np.zeros(len(data), bool)
    wanted[np.repeat(starts, room) + rel] = True
    words = words_at(data)
    order = suffix_order(data, wanted, words)
    head = np.flatnonzero(common_prefixes(words, order, length) < length)
    own = np.repeat(np.arange(len(sizes)), sizes)[order]
    least = np.minimum.reduceat(ids[own], head)
    lost = ids[own] > np.repeat(least, np.diff(np.append(head, len(order))))
    return np.bincount(own[lost], 2.0 ** (order[lost] - starts[own[lost]]), len(starts)).astype("<u4")


def judged(length: int):
    def judge(table: pa.Table) -> pa.Table:
        parts, echoes = np.array(table["part"].to_pylist()), table["hot"].to_pylist()
        places, sizes, rests, ids = (numbers(table, *x) for x in (("places", "<i8"), ("sizes", "u1"), ("rests", "<u2"), ("ids", "<i8")))
        part = np.repeat(parts, [len(p) for p in places])
        places, sizes, rests, ids = (np.concatenate(x) for x in (places, sizes, rests, ids))
        sizes = sizes.astype(np.int64)
        data = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
        starts = np.cumsum(sizes) - sizes
        masks = np.zeros(len(sizes), np.uint32)
        by = np.argsort(rests, kind="stable")
        edge = cuts(rests[by])
        filled = np.append(0, np.cumsum(sizes[by]))[edge]
        i = 0
        while i + 1 < len(edge):
            j = max(i + 1, int(np.searchsorted(filled, filled[i] + CHUNK, "right")) - 1)
            some = by[edge[i] : edge[j]]
            size = sizes[some]
            new = np.cumsum(size) - size
            within = np.arange(size.sum()) - np.repeat(new, size)
            masks[some] = repeated(data[np.repeat(starts[some], size) + within], new, size, ids[some], length)
            i = j
        some = np.flatnonzero(masks)
        some = some[np.argsort(part[some], kind="stable")]
        edge = cuts(part[some])
        rows = [(int(part[some[i]]), places[some[i:j]].tobytes(), masks[some[i:j]].tobytes(), None) for i, j in zip(edge[:-1], edge[1:])]
        return made(FOUND, rows + [(int(p), b"", b"", e) for p, e in zip(parts, echoes) if e is not None])

    return judge


def marked(length: int, schema: str):
    def mark(table: pa.Table, found: pa.Table) -> pa.Table:
        part = Part.of(table)
        n = len(part.slab.data)
        hit = np.zeros(n + 1, bool)
        if len(found):
            places, masks = (np.concatenate(numbers(found, *x)) for x in (("places", "<i8"), ("masks", "<u4")))
            for bit in range(SPREAD):
                hit[places[(masks >> np.uint32(bit)) & np.uint32(1) == 1] + bit] = True
            hot = next((np.frombuffer(x, "<u8") for x in found["hot"].to_pylist() if x is not None), np.zeros(0, np.uint64))
            if len(hot):
                at, h = part.anchors(length)
                order, head, docs = part.own_runs(at[members(h, hot)], length)
                ids, count = part.ids[docs], np.diff(np.append(head, len(order)))
                leader = np.minimum.reduceat(ids, head)
                # The run's first string with the leader's id was sent: if that is repeated elsewhere, all of the run are.
                sent = order[head + _first(ids == np.repeat(leader, count), head)]
                hit[order[(ids > np.repeat(leader, count)) | np.repeat(hit[sent], count)]] = True
        at = np.flatnonzero(hit)
        run = np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1)[: n + 1]
        gone = np.cumsum(run)[:n] > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[part.slab.offsets[:-1]] = gone[part.slab.offsets[:-1]]
        removed, spans = part.slab.counted(gone), part.slab.counted(begins)
        kept = [part.slab.data[i:j][~gone[i:j]].tobytes() if r else part.slab.text(k) for k, (i, j, r) in enumerate(zip(part.slab.offsets[:-1], part.slab.offsets[1:], removed))]
        shas = [hashlib.sha256(x).hexdigest() for x in kept]
        rows = list(zip(part.ids.tolist(), part.raws.tolist(), removed.tolist(), spans.tolist(), shas, kept))
        return made(schema, rows if schema.endswith("binary") else [r[:-1] for r in rows])

    return mark


def suffix_dedup(spark: SparkSession, docs: DataFrame, length: int = 50, part: int = PART, hot: int = HOT, kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (kept: the remaining bytes) of every row of docs (doc_id, text)."""
    if not SPREAD < length <= 50:
        raise ValueError(f"length is over {SPREAD} and at most 50")
    store = Store(spark, "suffix-dedup")
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("raw"), text.alias("text"))
    signed = store.put(plain.select("doc_id", "raw", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "signed")
    heads = signed.groupBy("sha").agg(F.min("doc_id").alias("head"))
    signed = store.put(spread_join(store, signed, heads, ["sha"]).withColumn("copy", F.coalesce(F.col("doc_id") > F.col("head"), F.lit(False))), "grouped")

    size = signed.where("doc_id is not null and not copy").agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    parts = max(1, -(-size // part))
    bits, near = ((-(-parts // of) - 1).bit_length() for of in (ANCHORS_OF, AROUND_OF))
    copies = store.put(signed.where("copy").select("doc_id", "raw").distinct(), "copies")
    heads = with_ids(plain.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)), copies, ["doc_id", "raw"], "left_anti")
    # Read three times, shuffled once: the exchange is the same in all three.
    texts = heads.select(F.pmod(F.xxhash64("doc_id", "raw"), F.lit(parts)).alias("part"), "doc_id", "raw", "text")
    sent = texts.groupBy("part").applyInArrow(screened(length, bits), SENT)
    shared = sent.groupBy("bucket").applyInArrow(answered(hot), SHARED)
    around = texts.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(surroundings(length, near), AROUND)
    found = around.groupBy("bucket").applyInArrow(judged(length), FOUND)
    kind = "doc_id long, raw long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept
    verdict = store.put(texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(marked(length, kind), kind), "verdict")

    met = signed.join(verdict, ["doc_id", "raw"], "left")
    whole = F.col("copy") & (F.col("n_bytes") >= length)
    removed = F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed")
    spans = F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans")
    sha = F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256")
    if not kept:
        return met.select("doc_id", "n_bytes", removed, spans, sha)
    # What no part has judged is whole, or gone whole.
    short = with_ids(plain, store.put(verdict.select("doc_id", "raw"), "judged"), ["doc_id", "raw"], "left_anti").select("doc_id", "raw", F.encode("text", "UTF-8").alias("own")).dropDuplicates(["doc_id", "raw"])
    met = met.join(short.withColumnRenamed("doc_id", "__id").withColumnRenamed("raw", "__raw"), F.col("__raw").eqNullSafe(F.col("raw")) & F.col("__id").eqNullSafe(F.col("doc_id")), "left")
    return met.select("doc_id", "n_bytes", removed, spans, sha, F.when(whole, F.lit(b"")).otherwise(F.coalesce("kept", "own")).alias("kept"))
