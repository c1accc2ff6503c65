"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document belongs
to), so the flow's network has a node for each pattern and each source, never one for a
document.  A pattern's words can be taken up to `epochs` times; the k-th time costs k, so
repetition costs are convex and the cheapest flow repeats as evenly as it can.  Arcs from
patterns lead to the sources in them, and each source draws its quota.  Successive shortest
paths find the flow.  What flows from a pattern to a source is whole epochs of all its
documents plus a rest, for which documents are selected in the order of a seeded hash.

The order is cut in two steps, so that no source's documents meet in one task: sums by
source and 4096 ranges of the hash find the range in which the rest runs out, and only the
documents of that range are ordered one by one.  A document that does not fit is passed over:
from there the cut is repeated for what is still open, among the documents no longer than
that, until none that fits is left.  Reruns agree.

Defined cases: null text has size 0; null sources are a source of their own, last in order;
documents of size 0 are never taken; a very long document is taken whole or not at all;
repeated rows and rows without an id count each; without any words all targets are 0; an
empty table gives an empty result; further columns are ignored, whatever their names, and
mixed_documents() keeps them; the number of patterns is bounded by the catalogue of sources and kept on
the driver, documents never are.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexor.llm.store import Store, free, with_ids

WORD = r"[^\x20\x09-\x0D]++"
#: The sources' weights, repeating in code-point order.
WEIGHTS = (5.0, 2.0, 1.0)
RANGES = 4096
#: A document's place in the order of selection, and a round of it.
SPOT = "struct<range: long, key: long, row: long>"
ROUND = f"struct<gap: double, after: {SPOT}, until: {SPOT}>"


def targets(sizes: dict[str | None, int], epochs: int = 3, weights: tuple[float, ...] = WEIGHTS) -> dict[str | None, float]:
    """Shares of all words by weight, none above `epochs` times its source; the excess goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = float(sum(sizes.values()))
    out: dict[str | None, float] = {}
    open_, left = list(order), total
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > epochs * sizes[s]]
        if not over:
            return out | {s: share * weight[s] for s in open_}
        for s in over:
            out[s] = float(epochs * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def min_cost_flow(supply: dict[frozenset, int], quota: dict[str | None, float], epochs: int) -> dict[tuple[frozenset, str | None], float]:
    """Words that flow from each pattern to each source: the most that can, at the least cost.

    Successive shortest paths with potentials; an epoch of a pattern is an arc of its own.
    """
    patterns, sources = list(supply), list(quota)
    first = 2 + len(patterns)
    nodes = first + len(sources)
    arcs: list[list[float]] = []  # to, capacity, cost; the reverse arc is the next or the one before
    out: list[list[int]] = [[] for _ in range(nodes)]

    def arc(a: int, b: int, room: float, cost: float) -> int:
        arcs.extend(([b, room, cost], [a, 0.0, -cost]))
        out[a].append(len(arcs) - 2)
        out[b].append(len(arcs) - 1)
        return len(arcs) - 2

    links = {}
    for i, p in enumerate(patterns):
        for k in range(1, epochs + 1):
            arc(0, 2 + i, float(supply[p]), float(k))
        for s in p:
            links[p, s] = arc(2 + i, first + sources.index(s), float("inf"), 0.0)
    for j, s in enumerate(sources):
        arc(first + j, 1, quota[s], 0.0)
    high = [0.0] * nodes
    least = 1e-6
    while True:
        far, via, heap = [float("inf")] * nodes, [-1] * nodes, [(0.0, 0)]
        far[0] = 0.0
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in out[a]:
                b, room, cost = arcs[e]
                if room > least and (new := d + cost + high[a] - high[b]) < far[b] - 1e-12:
                    far[b], via[b] = new, e
                    heapq.heappush(heap, (new, b))
        if via[1] < 0:
            return {k: arcs[e ^ 1][1] for k, e in links.items()}
        high = [h + f if f < float("inf") else h for h, f in zip(high, far)]
        path, b = [], 1
        while b:
            path.append(via[b])
            b = arcs[via[b] ^ 1][0]
        room = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= room
            arcs[e ^ 1][1] += room


def place() -> Column:
    return F.struct("range", "key", "row")


def selections(spark: SparkSession, rows: DataFrame, rests: dict[tuple, float]) -> dict[tuple, list[tuple]]:
    """The rounds (gap, after, until) of each pattern (sources) of rows that has a rest to select.

    A round takes the documents no longer than its gap between two places.  It ends at the first
    that does not fit with those before it, which the next round passes over; the last round
    of a pattern ends with its documents, or nothing that is left fits its gap.
    """
    out: dict[tuple, list[tuple]] = {p: [] for p in rests}
    # The driver holds a row for each pattern, so these are broadcast: no pattern's documents are shuffled to one task.
    live: dict[tuple, tuple] = {p: (gap, None) for p, gap in rests.items()}
    run = Window.partitionBy("sources").orderBy("range")
    order = Window.partitionBy("sources").orderBy("key", "row")
    while live:
        state = spark.createDataFrame([(list(p), *at) for p, at in live.items()], f"sources array<string>, gap double, after {SPOT}")
        open_ = rows.where("size > 0").join(F.broadcast(state), "sources").where((F.col("size") <= F.col("gap")) & (F.isnull("after") | (place() > F.col("after"))))
        spread = open_.groupBy("sources", "range").agg(F.first("gap").alias("gap"), F.sum("size").alias("size"))
        cut = spread.withColumn("sum", F.sum("size").over(run)).where(F.col("sum") > F.col("gap"))
        cut = cut.groupBy("sources").agg(F.min("range").alias("cut"), (F.min_by("sum", "range") - F.min_by("size", "range")).alias("before"))
        cuts = [(r["sources"], r["cut"], r["before"]) for r in cut.collect()]  # one row for each pattern
        found = {}
        if cuts:
            at_cut = open_.join(F.broadcast(spark.createDataFrame(cuts, "sources array<string>, cut long, before long")), "sources").where("range = cut")
            past = at_cut.withColumn("sum", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("sum") > F.col("gap"))
            ends = past.groupBy("sources").agg(F.min(F.struct(place().alias("until"), (F.col("sum") - F.col("size")).alias("got"))).alias("end"))
            found = {tuple(r["sources"]): (tuple(r["end"]["until"]), r["end"]["got"]) for r in ends.collect()}  # one row for each pattern
        for p, (gap, after) in live.items():
            out[p].append((gap, after, found[p][0] if p in found else None))
        live = {p: (live[p][0] - got, until) for p, (until, got) in found.items() if live[p][0] - got >= 1}
    return out


def mix(spark: SparkSession, docs: DataFrame, members: Column | None = None, epochs: int = 3, weights: tuple[float, ...] = WEIGHTS, seed: int = 42) -> DataFrame:
    """doc_id, raw, size, sources, source_size, target, taken of every row of docs (doc_id, text, and what members needs).

    members: array of the sources of a document; by default its column `source` alone.  A
    document in several sources has the figures of the one that most of its pattern's words flow to; raw is a hash of text and sources.
    """
    store = Store(spark, "mixing")
    sources = F.array(F.col("source")) if members is None else F.array_sort(F.array_distinct(members))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    raw = F.xxhash64("text", sources)
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), raw)).otherwise(F.xxhash64(F.lit(seed), F.col("doc_id")))
    rows = store.put(docs.select("doc_id", raw.alias("raw"), words.alias("size"), sources.alias("sources"), key.alias("key"), F.monotonically_increasing_id().alias("row"), F.shiftrightunsigned(key, 52).alias("range")), "rows")
    spread = store.put(rows.groupBy("sources", "range").agg(F.sum("size").alias("size")), "ranges")

    supply = {tuple(r["sources"]): r["size"] for r in spread.groupBy("sources").agg(F.sum("size").alias("size")).collect()}  # one row for each pattern
    sizes: dict[str | None, int] = {}
    for pattern, size in supply.items():
        for s in pattern:
            sizes[s] = sizes.get(s, 0) + size
    quota = targets(sizes, epochs, weights)
    flow = min_cost_flow({frozenset(p): n for p, n in supply.items()}, quota, epochs)

    plan = []
    for pattern, size in supply.items():
        amount = {s: flow.get((frozenset(pattern), s), 0.0) for s in pattern}
        total = sum(amount.values())
        whole = min(epochs, int((total + 0.5) // size)) if size else 0
        main = max(pattern, key=lambda s: (amount[s], s or "")) if len(pattern) > 1 else pattern[0]
        plan.append((list(pattern), sizes[main], quota[main], whole, float(max(0.0, total - whole * size)) if whole < epochs else 0.0))
    planned = spark.createDataFrame(plan, "sources array<string>, source_size long, target double, whole int, rest double")

    planned = store.put(planned, "plan")
    # Plans have a row for each pattern: Spark broadcasts them when they are small, which it measures.
    rounds = selections(spark, rows, {tuple(p): rest for p, _, _, _, rest in plan if rest > 0})
    kept = spark.createDataFrame([(list(p), r) for p, r in rounds.items()], f"sources array<string>, rounds array<{ROUND}>")
    filled = rows.join(planned, "sources").join(store.put(kept, "rounds"), "sources", "left")
    fits = F.exists("rounds", lambda r: (F.col("size") <= r["gap"]) & (F.isnull(r["after"]) | (place() > r["after"])) & (F.isnull(r["until"]) | (place() < r["until"])))
    more = F.coalesce(fits, F.lit(False)) & (F.col("size") > 0)
    taken = F.col("size") * (F.col("whole") + more.cast("int"))
    return filled.select("doc_id", "raw", "size", "sources", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame, members: Column | None = None, **options) -> DataFrame:
    """The rows of docs as the mix has them: left out, once or repeated; all columns stay.

    Rows alike in id, text and sources can't be told apart: where the mix takes them differently often, one stands for all.
    """
    store = Store(spark, "mixed")
    sources = F.array(F.col("source")) if members is None else F.array_sort(F.array_distinct(members))
    none, name, raw, times, copy = (free(docs, n) for n in ("__none", "__id", "__raw", "__times", "__copy"))
    key = [F.col("doc_id").isNull().alias(none), F.coalesce("doc_id", F.lit(0)).cast("long").alias(name)]
    on = [none, name, raw]
    often = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(0)).alias(times)
    rows = mix(spark, docs, members, **options).select(*key, F.col("raw").alias(raw), often)
    alike = store.put(rows.groupBy(*on).agg(F.max(times).alias(times), F.min(times).alias("least"), F.sum(times).cast("int").alias("all")), "times")
    marked = docs.select("*", *key, F.xxhash64("text", sources).alias(raw))
    out = with_ids(marked, alike.where(F.col(times) > 0).where(F.col("least") == F.col(times)).select(*on, times), on, "inner").select(*marked.columns, times)
    uneven = store.put(alike.where(F.col("least") < F.col(times)).select(*on, F.col("all").alias(times)), "uneven")
    if not uneven.isEmpty():
        out = out.unionByName(with_ids(marked, uneven, on, "inner").dropDuplicates(on).select(*marked.columns, times))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
