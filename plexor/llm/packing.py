"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents become ids with an end id; only those longer than a sequence are cut, into full
pieces and a rest.  Full pieces are sequences of their own.  The others are dealt by hash
into blocks of about `block` pieces (so neither a source nor a group of copies lands in
one), and each block is evolved on several islands.  A solution is a list of bins; the first
one comes of best fit in descending order, so that no block needs more bins than that gives, the
others of best fit in random orders.  Crossover injects the well-filled bins of
one parent whole into the other, removes the bins there that hold the same pieces, and puts
what that displaces back by best fit in descending order; mutation empties the worst-filled
bins likewise.  After each epoch every island's elite migrates to the next island.  A block
is done when it has no more bins than its tokens need.  Bins that are not full are taken apart
and their pieces, from all blocks, packed again, level by level, as long as that saves sequences.

Defined cases: null and empty texts are one piece of the end id alone; repeated rows are
packed one by one; an empty table gives an empty result; a document of any length is cut
without gaps; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexor.llm.store import Store, scan
from plexor.llm.tokens import token_table
from plexor.llm.words import slabs

Bins = list[list[int]]
PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, path: str, size: int, end: int) -> DataFrame:
    """PIECES of every row of docs (doc_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, uid = token_table(path), TaskContext.get().partitionId() << 36
        for batch in batches:
            for slab in slabs(batch.column(1)):
                ids, bounds = table.ids(slab)
                ids = np.insert(ids.astype("<u4"), bounds[1:], end)
                bounds = bounds + np.arange(len(bounds))
                pieces = -(-np.diff(bounds) // size)
                doc = np.repeat(np.arange(len(slab)), pieces)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = bounds[doc] + k * size
                stop = np.minimum(start + size, bounds[doc + 1])
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(start.tolist(), stop.tolist())]
                columns = [pa.array(uid + np.arange(len(doc))), batch.column(0).take(pa.array(slab.first + doc)), pa.array(k.astype(np.int32)), pa.array(k * size), pa.array(stop - start), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PIECES.split(", ")])
                uid += len(doc)

    return scan(docs.select("doc_id", "text"), cut, PIECES)


class Solution:
    """Bins of item numbers, and how full each is."""

    def __init__(self, bins: Bins, fills: list[int]):
        self.bins, self.fills = bins, fills

    @property
    def fitness(self) -> tuple[int, int]:
        """Fewer bins are better; of as many, those filled most unevenly, as they leave the most usable room."""
        return -len(self.bins), sum(f * f for f in self.fills)


def solution(bins: Bins, lengths: list[int]) -> Solution:
    return Solution(bins, [sum(map(lengths.__getitem__, b)) for b in bins])


def descending(items: list[int], lengths: list[int]) -> list[int]:
    return sorted(items, key=lambda i: (-lengths[i], i))


def best_fit(items: list[int], lengths: list[int], size: int, into: Solution) -> Solution:
    """Puts each item, in order, into the fullest bin that has room."""
    bins, fills = into.bins, into.fills
    room = sorted((size - f, k) for k, f in enumerate(fills))
    for i in items:
        n = lengths[i]
        at = bisect_left(room, (n, -1))
        if at == len(room):
            bins.append([i])
            fills.append(n)
            insort(room, (size - n, len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            fills[k] += n
            insort(room, (left - n, k))
    return into


def crossover(to: Solution, source: Solution, lengths: list[int], size: int, rng: random.Random) -> Solution:
    """Whole well-filled bins of source in `to`, without duplicates, the displaced items by best fit."""
    well = [k for k, f in enumerate(source.fills) if f >= size * 0.995] or range(len(source.bins))
    taken = rng.sample(well, max(1, len(well) // rng.randint(2, 4)))
    inside = {i for k in taken for i in source.bins[k]}
    kept, displaced = Solution([list(source.bins[k]) for k in taken], [source.fills[k] for k in taken]), []
    for b, f in zip(to.bins, to.fills):
        if inside.isdisjoint(b):
            kept.bins.append(list(b))
            kept.fills.append(f)
        else:
            displaced += [i for i in b if i not in inside]
    return best_fit(descending(displaced, lengths), lengths, size, kept)


def mutate(old: Solution, lengths: list[int], size: int, rng: random.Random) -> Solution:
    """The worst-filled bins and as many others emptied, their items put back by best fit in nearly descending order."""
    order = sorted(range(len(old.bins)), key=old.fills.__getitem__)
    n = min(len(order), 2 + rng.randrange(1 + len(order) // 20))
    gone = {*order[:n], *rng.sample(order[n:], min(len(order) - n, n))}
    displaced = [i for k in gone for i in old.bins[k]]
    spread = rng.choice((0.1, 0.5, 1.0))
    displaced.sort(key=lambda i: -lengths[i] * (1 + spread * rng.uniform(-1, 1)))
    left = [k for k in range(len(old.bins)) if k not in gone]
    return best_fit(displaced, lengths, size, Solution([list(old.bins[k]) for k in left], [old.fills[k] for k in left]))


def evolve(lengths: list[int], size: int, elites: list[Bins], seed: int, generations: int, population: int = 4) -> tuple[Bins, int]:
    """(the best solution, the generations that ran): ends when no fewer bins are possible, or the generations are used up.

    The pool begins with best fit in descending order, so no result has more bins than that.
    """
    rng = random.Random(seed)
    least = -(-sum(lengths) // size)
    order = list(range(len(lengths)))
    pool = [solution(b, lengths) for b in elites] or [best_fit(descending(order, lengths), lengths, size, Solution([], []))]
    while len(pool) < population and min(len(s.bins) for s in pool) > least:
        rng.shuffle(order)
        pool.append(best_fit(order, lengths, size, Solution([], [])))
    scored = [(s.fitness, s) for s in pool]
    ran = 0
    while ran < generations and -max(f for f, _ in scored)[0] > least:
        a, b = rng.sample(range(len(scored)), 2)
        child = crossover(scored[a][1], scored[b][1], lengths, size, rng)
        if rng.random() < 0.5:
            child = mutate(child, lengths, size, rng)
        new = child.fitness
        worst = min(range(len(scored)), key=lambda k: scored[k][0])
        if new > scored[worst][0]:
            scored[worst] = (new, child)
        ran += 1
    return max(scored, key=lambda x: x[0])[1].bins, ran


ISLANDS = "block long, island int, items array<struct<length: long, uid: long>>, elites array<array<int>>, ran int"


def _epoch(state: DataFrame, size: int, generations: int, seed: int) -> DataFrame:
    """One epoch on every island; elites are the bin numbers of the items, before and after; ran counts generations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, count = [], []
            for block, island, items, elites, before in zip(*(batch.column(i) for i in range(5))):
                lengths = items.values.flatten()[0].to_pylist()
                pool = []
                for numbers in elites.as_py() or []:
                    bins: Bins = [[] for _ in range(max(numbers, default=-1) + 1)]
                    for i, k in enumerate(numbers):
                        bins[k].append(i)
                    pool.append(bins)
                best, ran = evolve(lengths, size, pool, seed * 1_000_003 + block.as_py() * 101 + island.as_py(), generations)
                number = np.empty(len(lengths), np.int32)
                for k, b in enumerate(best):
                    number[b] = k
                out.append([number])
                count.append(before.as_py() + ran)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.list_(pa.list_(pa.int32()))), pa.array(count, pa.int32())], ["block", "island", "items", "elites", "ran"])

    return scan(state, run, ISLANDS)


def _bins(state: DataFrame) -> DataFrame:
    """uid, length, block, bin, fill of every item of solved blocks."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, items, elites in zip(*(batch.column(i) for i in range(3))):
                length, uid = (x.to_numpy() for x in items.values.flatten())
                number = elites.values.flatten().to_numpy().astype(np.int64)
                fill = np.bincount(number, length).astype(np.int64)
                order = np.lexsort((uid, -length, number))
                run = np.cumsum(length[order]) - length[order]
                head = np.concatenate([[0], np.cumsum(fill)])[number[order]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[order]), pa.array(length[order]), pa.array(np.full(len(uid), block.as_py())), pa.array(number[order]), pa.array(run - head), pa.array(fill[number[order]])],
                    ["uid", "length", "block", "bin", "offset", "fill"],
                )

    return scan(state.select("block", "items", "elites"), spread, "uid long, length long, block long, bin long, offset long, fill long")


def evolved(store: Store, items: DataFrame, blocks: int, size: int, islands: int, epochs: int, generations: int, level: int) -> DataFrame:
    """block, island, items, elites (one), ran: every island's best after all epochs."""
    dealt = items.groupBy(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("length", "uid"))).alias("items"))  # about `block` items each
    state = dealt.select("block", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), "items", F.array().cast("array<array<int>>").alias("elites"), F.lit(0).alias("ran"))
    for epoch in range(epochs):
        state = store.put(_epoch(state.repartition(max(1, min(blocks * islands, 10_000)), "block", "island"), size, generations, epoch), f"epoch-{level}-{epoch}")
        if epoch + 1 < epochs:
            came = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elites").alias("others"))
            state = state.join(came, ["block", "island"]).select("block", "island", "items", F.concat("elites", "others").alias("elites"), "ran")
    return state


def pack(spark: SparkSession, items: DataFrame, size: int = 4096, block: int = 4000, islands: int = 2, epochs: int = 2, generations: int = 40, enough: float = 1.0) -> DataFrame:
    """uid, sequence_id, offset of items (uid, length below size), in as few sequences as it can."""
    store = Store(spark, "packing")
    done, level, before = [], 0, float("inf")
    while True:
        blocks = max(1, -(-items.count() // block))
        state = evolved(store, items, blocks, size, islands, epochs, generations, level)
        count = F.array_max(F.col("elites")[0])
        best = state.groupBy("block").agg(F.min_by(F.struct("items", "elites"), F.struct(count, F.col("island"))).alias("best")).select("block", "best.items", "best.elites")
        placed = store.put(_bins(best.repartition(max(1, min(blocks, 10_000)), "block")), f"level-{level}")
        full = F.col("fill") >= F.lit(int(size * enough))
        rest = placed.where(~full)
        open_ = rest.agg(F.count(F.when(F.col("offset") == 0, 1)).alias("bins"), F.sum("length").alias("tokens")).first()
        sequence = (F.lit(level) * F.lit(1 << 56) + F.col("block") * F.lit(1 << 16) + F.col("bin")).cast("long")
        out = placed.select("uid", sequence.alias("sequence_id"), "offset", full.alias("full"))
        # Nothing to gain in one block, where the tokens need as many, or where this level saved none.
        if blocks == 1 or open_["bins"] <= -(-(open_["tokens"] or 0) // size) or open_["bins"] >= before:
            done.append(out.drop("full"))
            break
        done.append(out.where("full").drop("full"))
        items, level, before = rest.select("uid", "length"), level + 1, open_["bins"]
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def pack_documents(spark: SparkSession, docs: DataFrame, path: str, size: int = 4096, end: int = 1, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = Store(spark, "pieces").put(cut_pieces(docs, path, size, end), "pieces")
    packed = pack(spark, pieces.where(F.col("length") < size).select("uid", "length"), size, **options)
    alone = pieces.where(F.col("length") == size).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    return pieces.join(packed, "uid").unionByName(alone).drop("uid")
