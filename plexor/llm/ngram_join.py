"""Near duplicates: an exact join in the metric space of Jaccard distances.

Documents are sets of hashed shingles (runs of five words, A-Z lower-cased).  Distance is
1 - Jaccard, a metric; documents link at a distance of at most 1 - threshold.

1. Documents with equal sets are one class; only a class's first row goes on.
2. Screening.  A set's sketch is its SKETCH smallest hashes.  Sets that link share at least
   ``needed()`` of them: that is certain for sets so small that a partner's sketch is whole
   too, and for larger ones fails with a chance below 2^-64 a pair (a binomial tail bound),
   which is the chance that two shingles' 64-bit hashes are the same.  A set of whose sketch
   fewer members are in any other sketch links with nothing.  From here on all is exact, on
   whole sets: a set of which less than the threshold is in any other set links with nothing.
3. Voronoi regions, first level.  Two sets that link share a shingle among the first
   ``n - ceil(threshold * n) + 1`` of each (its prefix), in ascending order of how many sets
   have a shingle.  Of the sets with a shingle in their prefixes, the one that has most in
   common with others is a pivot.  Each set is compared with its pivots and is in the
   regions of all of them: two sets that link have a pivot in common.  If that shingle is the
   first that two sets share, no more can be in common than what is left of each from its
   place on (`shared` in a region), which must reach the link.  The smaller of two sets that
   link therefore has it so early that what is left would do for a set of its own size: such
   sets are a region's core, and a shingle that is in nobody's core makes no region.  So text
   that a whole group shares, but too little of it to link, brings nobody together.
4. Regions join recursively.  A region of more than `small` sets gets several pivots of
   different components; every set in it is compared with all of them and goes to the
   nearest one's region.  By the triangle inequality, sets that link have distances to any
   pivot that differ by no more than the link distance r, so a set can link with one of
   region q's core only if it is no farther from q than the core's farthest set is, or nearer
   than its nearest, by more than r, nor farther than from its own pivot by more than 2 r:
   such boundary documents are replicated.  Where regions overlap so much that this
   doesn't divide them (a dense group), the region stays one and goes on with ever more
   pivots, which leave it once all has been compared with them.
5. In a region only sets of different components are compared, and only where sizes, the
   windows and `profile` leave it possible that they link: the parities of a set's shared
   members by hash, of which two sets that differ in k members differ in k at most, whatever
   they share.  So copies cost no pairs within a group.  Every link is decided on whole sets.
6. Links are merged into components after every level.

What is given per document is the component, not all of its links.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing;
with fewer words than a shingle has, the whole sequence is one; very long texts are shingled
whole; repeated rows are of one class; rows without an id take part, and have no component
if no member of it has an id; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexor.llm.store import Store, release, scan, with_ids, without
from plexor.llm.words import slabs, windows

SKETCH = 64
SHARED = 12
#: Words of a profile.  Larger sets than need these have weaker profiles, so more of their pairs are compared; the result is the same.
WORDS = 64


def tail_bits(threshold: float, sketch: int = SKETCH, shared: int = SHARED) -> float:
    """Chernoff bound, in bits: sets that link have fewer than `shared` members in common with a chance below 2^-bits."""
    p = (shared - 1) / sketch
    return sketch * (p * math.log2(p / threshold) + (1 - p) * math.log2((1 - p) / (1 - threshold)))


def needed(n: Column, percent: int) -> Column:
    """Sketch members that a set of size n shares with any set it links with.

    A partner has at most n * 100 / percent members; if that is no more than a sketch, both sketches are whole.
    """
    certain = F.ceil(n * percent / 100)
    return F.when(n * 100 <= SKETCH * percent, certain).otherwise(F.least(certain, F.lit(SHARED)))


def shingle_sets(docs: DataFrame, width: int, whole: bool) -> DataFrame:
    """doc_id, raw, n, d1, d2 (128-bit digest of the set) and the set: whole, or its sketch."""
    names = ["doc_id", "raw", "n", "d1", "d2", "members"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column(2)):
                slab.prepare(lower=True)
                starts, ends, bounds = slab.words()
                h, at = windows(slab.hashes(starts, ends), bounds, width)
                sets = [np.unique(h[at[i] : at[i + 1]]) for i in range(len(slab))]
                both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
                members = sets if whole else [s[:SKETCH] for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(m) for m in members])]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(members).view(np.int64)))
                own = [c.slice(slab.first, len(slab)) for c in (batch.column(0), batch.column(1))]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), flat], names)

    return scan(docs.select("doc_id", F.xxhash64("text").alias("raw"), "text"), build, "doc_id long, raw long, n long, d1 long, d2 long, members array<long>")


#: Edges whose components one task finds, in some 10 MB.
FEW_EDGES = 100_000


def few_components(edges: DataFrame) -> DataFrame:
    """components() of at most FEW_EDGES edges, in one task."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1) for b in batches]
        if not pairs:
            return
        names, ends = np.unique(np.concatenate(pairs), return_inverse=True)
        a, b = ends.reshape(-1, 2).T
        label = np.arange(len(names))
        while (label[a] != label[b]).any():
            least = np.minimum(label[a], label[b])
            for end in (a, b):
                np.minimum.at(label, label[end], least)
            label = label[label]
        while (label[label] != label).any():
            label = label[label]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], ["v", "label"])

    return edges.select("a", "b").repartition(1).mapInArrow(join, "v long, label long")


def components(store: Store, edges: DataFrame) -> DataFrame:
    """v, label: the smallest vertex that each one of edges (a, b) is connected with.

    Beyond FEW_EDGES, by smallest neighbouring labels with pointer jumping; every round is a
    written table, nothing is collected.  Components are the same either way.
    """
    if edges.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
        return store.put(few_components(edges), "components")
    both = store.put(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = store.put(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = lower.select(F.col("v").alias("label"), F.col("label").alias("next"))
        new = store.put(lower.join(jump, "label").select("v", "old", F.least("label", "next").alias("label")), "labels")
        store.drop(labels)
        if new.where("label <> old").isEmpty():
            store.drop(both)
            return new.select("v", "label")
        labels = new.select("v", "label")
        labels.store_path = new.store_path


def profile(g: np.ndarray, n: int) -> np.ndarray:
    """How many g are, then parities of their counts by the last bits of g, 64 a word; 2 n bits or the next power of two for a set of size n."""
    bits = 64 * min(WORDS, 1 << max(0, (2 * n - 1).bit_length() - 6))
    odd = np.bincount(g & (bits - 1), minlength=bits) & 1
    return np.concatenate([[len(g)], np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")])


#: What a region has of a set c: its size, how much it can have in common there, its profile, how much it has in common with any, its component.
FACTS = ["c", "n", "shared", "profile", "common", "comp"]


def held_twice(members: DataFrame) -> DataFrame:
    """g, df of the members (c, g) that two or more sets have."""
    return members.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")


def ranked(held: DataFrame, percent: int) -> DataFrame:
    """c, n, shared, profile, common and prefix of the sets that can link at all, from c, n and held (df and g of each shared member)."""
    names = ["c", "n", "shared", "profile", "common", "prefix"]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c, n, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                df, g = (x.to_numpy() for x in members.values.flatten())
                if 100 * len(g) < percent * n:
                    continue
                # Members of one set alone come first in its order; a prefix ends so many places earlier among the others.
                length = n + (-n * percent) // 100 + 1 - (n - len(g))
                prefix = g[np.lexsort((g, df))[: max(0, length)]]
                rows.append((c, n, len(g), profile(g, n), float(np.log2(df).sum()), prefix))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.list_(pa.int64())]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(columns, kinds)], names)

    return scan(held.select("c", "n", "held"), rank, "c long, n long, shared long, profile array<long>, common double, prefix array<long>")


def seeds(store: Store, sets: DataFrame, wanted: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(facts of the sets that can link at all, with c, n, shared, profile, common; their prefixes g, c, left: shared members from g on).  wanted: c, n of the sets."""
    tokens = sets.select("c", F.explode("members").alias("g"))
    held = tokens.join(held_twice(tokens), "g").groupBy("c").agg(F.collect_list(F.struct("df", "g")).alias("held"))  # a set at most
    facts = store.put(ranked(with_ids(held, wanted, ["c"], "inner"), percent), "facts")
    release(sets.sparkSession)
    return facts.drop("prefix"), facts.select("c", "shared", F.posexplode("prefix").alias("at", "g")).select("g", "c", (F.col("shared") - F.col("at")).alias("left"))


def possible(x: str, y: str, percent: int) -> Column:
    """May the sets of rows x and y link?  By their components, sizes and profiles."""
    of = lambda row, name: F.col(f"{row}.{name}")
    n, m = of(x, "n"), of(y, "n")
    words = F.least(F.size(of(x, "profile")), F.size(of(y, "profile"))) - 1
    # A profile of twice the words, the most that sizes allow, folds into one of half of them.
    half = lambda p: F.zip_with(F.slice(p, 2, words), F.slice(p, words + 2, words), lambda u, v: u.bitwiseXOR(v))
    fold = lambda p: F.when(F.size(p) - 1 == words, F.slice(p, 2, words)).otherwise(half(p))
    odd = F.zip_with(fold(of(x, "profile")), fold(of(y, "profile")), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    twice = of(x, "profile")[0] + of(y, "profile")[0] - F.aggregate(odd, F.lit(0), lambda s, p: s + p)
    sized = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return (of(x, "comp") != of(y, "comp")) & sized & ((100 + percent) * F.least(of(x, "shared"), of(y, "shared")) >= percent * (n + m)) & ((100 + percent) * twice >= 2 * percent * (n + m))


def ordered(x: str, y: str) -> list[Column]:
    """a, b (the lesser first), and their components, of rows x and y."""
    swap = F.col(f"{x}.c") > F.col(f"{y}.c")
    pick = lambda name, first: F.when(swap == F.lit(first), F.col(f"{y}.{name}")).otherwise(F.col(f"{x}.{name}"))
    return [pick("c", True).alias("a"), pick("c", False).alias("b"), pick("comp", True).alias("ca"), pick("comp", False).alias("cb")]


class RegionJoin:
    """Joins regions (g, d, core, dense, and FACTS): sets c at distance d of the region's pivot.

    Every pair of sets that link must meet in a region, at least one of them in its core.
    """

    def __init__(self, store: Store, sets: DataFrame, percent: int, small: int, pivots: int):
        self.store, self.sets, self.percent, self.small, self.pivots = store, sets, percent, small, pivots
        self.reach = 1 - percent / 100
        self.links: DataFrame | None = None
        #: Tables of the pairs compared, by level.
        self.compared: list[DataFrame] = []

    def compare(self, pairs: DataFrame) -> DataFrame:
        """a, b, ca, cb, d, linked of distinct pairs (a, b, ca, cb)."""
        pairs = self.store.put(pairs.dropDuplicates(["a", "b"]), "pairs")
        ids = self.store.put(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "compared")
        sets = with_ids(self.sets, ids, ["c"])
        one = sets.select(F.col("c").alias("a"), F.col("members").alias("left"))
        two = sets.select(F.col("c").alias("b"), F.col("members").alias("right"))
        both = F.size(F.array_intersect("left", "right"))
        any_of = F.size("left") + F.size("right") - F.col("both")
        found = pairs.join(one, "a").join(two, "b").withColumn("both", both)
        out = self.store.put(found.select("a", "b", "ca", "cb", (1 - F.col("both") / any_of).alias("d"), (100 * F.col("both") >= self.percent * any_of).alias("linked")), "distances")
        self.compared.append(out)
        linked = out.where("linked").select("a", "b")
        self.links = linked if self.links is None else self.links.unionByName(linked)
        return out

    def merged(self, rows: DataFrame, found: DataFrame) -> DataFrame:
        """rows with components renewed by the links found."""
        edges = found.where("linked and ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        if edges.isEmpty():
            return rows
        labels = components(self.store, edges).select(F.col("v").alias("comp"), "label")
        return rows.join(labels, "comp", "left").withColumn("comp", F.coalesce("label", "comp")).drop("label")

    def first_level(self, facts: DataFrame, prefix: DataFrame) -> DataFrame:
        """The regions of step 3."""
        core = (100 + self.percent) * F.col("left") >= 2 * self.percent * F.col("n")
        seen = prefix.join(facts.select("c", "n", "common"), "c")
        heads = seen.groupBy("g").agg(F.max(F.struct("common", (-F.col("c")).alias("c"))).alias("p"), F.count("*").alias("k"), F.max(core).alias("any"))
        pivot = heads.where("k > 1 and any").select("g", (-F.col("p.c")).alias("pivot"))
        seen = self.store.put(prefix.join(pivot, "g").where("c <> pivot").groupBy("pivot", "c").agg(F.max("left").alias("left")), "seen")
        low, high = F.least("pivot", "c"), F.greatest("pivot", "c")
        found = self.compare(seen.select(low.alias("a"), high.alias("b"), low.alias("ca"), high.alias("cb")))
        near = seen.withColumns({"a": low, "b": high}).join(found.select("a", "b", "d"), ["a", "b"])
        # Which pivots a set is compared with depends on its prefix, so the nearest alone doesn't see all partners: the core is told by place.
        rows = near.join(facts.drop("shared"), "c").select(F.col("pivot").alias("g"), "d", core.alias("core"), F.lit(False).alias("dense"), "c", "n", F.col("left").alias("shared"), "profile", "common", F.col("c").alias("comp"))
        return self.store.put(self.merged(rows, found), "regions")

    def run(self, state: DataFrame) -> None:
        level = 0
        while (new := self.level(state, level)) is not None:
            self.store.drop(state)
            state, level = new, level + 1

    def level(self, state: DataFrame, level: int) -> DataFrame | None:
        """What is left to join after this level, or None."""
        put, reach = self.store.put, self.reach
        comps = put(state.groupBy("g", "comp").agg(F.count("*").alias("k"), F.max("core").alias("core"), F.max(F.struct("common", (-F.col("c")).alias("c"))).alias("head")), "components")
        stat = put(comps.groupBy("g").agg(F.sum("k").alias("all"), F.count("*").alias("comps"), F.max("core").alias("any")).where("any and comps > 1").select("g", "all"), "active")
        if stat.isEmpty():
            return None
        live = state.join(stat, "g").withColumn("few", F.col("all") <= self.small)
        window = F.abs(F.col("x.d") - F.col("y.d")) <= reach + 1e-9
        cored = F.col("x.core") | F.col("y.core")

        few = live.where("few")
        met = few.alias("x").join(few.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.c") < F.col("y.c")) & cored & window & possible("x", "y", self.percent))
        pairs = met.select(*ordered("x", "y"))

        # Pivots of different components: one for each of `pivots` parts of a region's components, of its largest there.
        many = live.where("not few").drop("few", "all")
        count = F.when(F.col("dense"), F.lit(min(self.pivots * 4**level, 1 << 30))).otherwise(F.lit(self.pivots))
        kinds = many.select("g", "dense").distinct()
        heads = comps.join(kinds, "g").groupBy("g", F.pmod(F.xxhash64("comp"), count).alias("part")).agg(F.max(F.struct("k", "head.common", "head.c")).alias("p")).select("g", (-F.col("p.c")).alias("c"))
        chosen = put(many.join(heads, ["g", "c"]), "pivots")
        x, y = chosen.alias("x"), many.alias("y")
        here = (F.col("x.g") == F.col("y.g")) & (F.col("x.c") != F.col("y.c"))
        told = x.join(y, here & F.col("x.dense") & cored & window & possible("x", "y", self.percent))
        split = x.join(y, here & ~F.col("x.dense"))
        wide = put(split.select(F.col("x.g").alias("g"), F.col("x.c").alias("q"), F.col("y.c").alias("c"), F.col("y.core").alias("core")), "to-divide")
        pairs = pairs.unionByName(told.select(*ordered("x", "y"))).unionByName(split.select(*ordered("x", "y")))

        found = self.compare(pairs)
        left = many.join(chosen.select("g", "c"), ["g", "c"], "left_anti")
        rest = self.merged(left.where("dense").unionByName(self.divided(left.where("not dense"), wide, found)), found)
        return put(rest.select("g", "d", "core", "dense", *FACTS), "left")

    def divided(self, rows: DataFrame, wide: DataFrame, found: DataFrame) -> DataFrame:
        """Voronoi regions of each region of rows around the pivots q of wide (g, q, c, core), or the region itself, as dense, where they overlap too much."""
        low, high = F.least("q", "c"), F.greatest("q", "c")
        far = wide.withColumns({"a": low, "b": high}).join(found.select("a", "b", "d"), ["a", "b"]).select("g", "q", "c", "core", F.col("d").alias("dq"))
        home = far.groupBy("g", "c").agg(F.min(F.struct("dq", "q")).alias("home")).select("g", "c", F.col("home.dq").alias("own"), F.col("home.q").alias("at"))
        near = far.join(home, ["g", "c"])
        edge = near.where("q = at and core").groupBy("g", "q").agg(F.min("dq").alias("lo"), F.max("dq").alias("hi"))
        slack = self.reach + 1e-9
        inside = (F.col("dq") <= F.col("own") + 2 * slack) & (F.col("dq") <= F.col("hi") + slack) & (F.col("dq") >= F.col("lo") - slack)
        cells = self.store.put(near.join(edge, ["g", "q"]).where(((F.col("q") == F.col("at")) & F.col("core")) | inside).select("g", "q", "c", "dq", ((F.col("q") == F.col("at")) & F.col("core")).alias("home")), "cells")
        sums = cells.groupBy("g", "q").agg(F.count("*").alias("k"), F.sum(F.col("home").cast("int")).alias("own"))
        worth = sums.groupBy("g").agg((F.sum("k") <= 2 * F.sum("own")).alias("thin"), (2 * F.max("k") <= F.sum("own")).alias("even")).select("g", (F.col("thin") & F.col("even")).alias("divides"))
        worth = self.store.put(worth, "worth")
        kept = rows.join(worth.where("divides"), "g", "left_anti").withColumn("dense", F.lit(True))
        parts = rows.drop("d", "core").join(cells, ["g", "c"]).join(worth.where("divides"), "g")
        parts = parts.select(F.xxhash64("g", "q").alias("g"), F.col("dq").alias("d"), F.col("home").alias("core"), "dense", *FACTS)
        return kept.unionByName(parts)


def joined(spark: SparkSession, docs: DataFrame, percent: int, width: int, small: int, pivots: int) -> DataFrame:
    """row, doc_id, raw, n, component (the least row of it), component_id of every row of docs."""
    if tail_bits(percent / 100) < 64:
        raise ValueError("sketches of this size serve similarities of 0.75 or more")
    store = Store(spark, "ngram-join")
    sketched = store.put(shingle_sets(docs, width, whole=False).withColumn("row", F.monotonically_increasing_id()), "sketched")
    signed = store.put(sketched.drop("members"), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = store.put(signed.groupBy("d1", "d2", "n").agg(first).select("d1", "d2", "n", F.col("first.row").alias("c"), "first"), "classes")

    heads = sketched.join(classes.where("n > 0").select(F.col("c").alias("row")), "row", "left_semi").select(F.col("row").alias("c"), F.explode("members").alias("g"))
    heads = store.put(heads, "heads")
    store.drop(sketched)
    release(spark)
    some = heads.join(held_twice(heads).select("g"), "g").groupBy("c").agg(F.count("*").alias("met"))
    wanted = store.put(some.join(classes, "c").where(F.col("met") >= needed(F.col("n"), percent)).select("c", "d1", "d2", "n"), "wanted")
    store.drop(heads)
    release(spark)

    raws = store.put(with_ids(signed.withColumnRenamed("row", "c"), wanted.select("c"), ["c"]).select("raw").distinct(), "raws")
    texts = with_ids(docs.select("doc_id", "text", F.xxhash64("text").alias("raw")), raws, ["raw"])
    whole = shingle_sets(texts, width, whole=True).join(wanted, ["d1", "d2", "n"]).dropDuplicates(["c"])
    sets = store.put(whole.select("c", "members"), "sets")

    work = RegionJoin(store, sets, percent, small, pivots)
    work.run(work.first_level(*seeds(store, sets, wanted.select("c", "n"), percent)))
    labels = components(store, work.links).select(F.col("v").alias("c"), "label")
    placed = store.put(classes.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c")).select("d1", "d2", "n", "label", "first"), "labelled")
    least = placed.groupBy("label").agg(F.min("first").alias("least"))
    named = store.put(placed.join(least, "label").select("d1", "d2", "n", F.col("least.row").alias("component"), F.col("least.doc_id").alias("component_id")), "named")
    alone = lambda other, own: F.when(F.col("n") > 0, F.col(other)).otherwise(F.col(own)).alias(other)
    return signed.join(named, ["d1", "d2", "n"]).select("row", "doc_id", "raw", "n", alone("component", "row"), alone("component_id", "doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 75, width: int = 5, small: int = 128, pivots: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).  percent: least similarity of a link, 75 or more."""
    return joined(spark, docs, percent, width, small, pivots).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def first_of_groups(spark: SparkSession, docs: DataFrame, percent: int = 75, width: int = 5, small: int = 128, pivots: int = 16) -> DataFrame:
    """One row of each component: that with the smallest doc_id, or the first row where none has one; all columns stay.

    Rows without shingles are linked with nothing, so all of them stay.
    """
    found = joined(spark, docs, percent, width, small, pivots)
    return without(docs, found.select("doc_id", "raw", (F.col("row") == F.col("component")).alias("kept")))
