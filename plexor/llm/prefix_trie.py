"""The trie of conversation prefixes, rolled up by pointer jumping.

1. Turns are put in order by ranges (conversation, turn, role, text), so that no conversation needs
   one task.  A turn's prefix gets a 128-bit digest: the exclusive or of the hashes of (place, role
   and text) up to it, a running sum in each range, to which the earlier ranges' sums of the same
   conversation are added (a row for each range).  The digest of the prefix before, its parent, is
   that without the turn's own hash, so an edge needs no look back.
2. A node is a digest; members are counted map-side first, so a first turn that a third of all
   conversations share is one row of each task.
3. Roll-up in doubling rounds.  After round j a node holds the sums over its descendants less than
   2^j below, and a pointer to its ancestor 2^j above.  In the next round each node's sums go to the
   node that it points at, and its pointer is replaced by that node's own.  So ceil(log2(depth + 1))
   rounds bring leaves and savings to every ancestor, however long a conversation is.
4. The members that end at a node are put in order by ranges too; runs of ids become strings that
   one task a node feeds to SHA-256, a string at a time.

Defined cases: null role and text are empty; a null turn comes first; turns of the same number go by
role, then text, and repeated rows are turns of their own; rows without a conv_id belong to no
conversation; a conversation without turns is a member of the root alone; very long texts are hashed
whole; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexor.llm.store import Store, spread_join

NODE = ["d1", "d2", "depth"]
TURN = ["c1", "c2", "chars"]


def ordered_turns(store: Store, turns: DataFrame) -> DataFrame:
    """conv, place (from 1), c1, c2 (hashes of role and text), chars of every turn (conv, turn, role, text); places are found by ranges, and texts go no further."""
    order = ["conv", "turn", "role", "text"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    hashed = [F.xxhash64("role", "text").alias("c1"), F.xxhash64(F.lit(0x5BD1E995), "text", "role").alias("c2"), F.length("text").cast("long").alias("chars")]
    ranged = store.put(ranged.select("conv", *hashed, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "ranged")
    own = Window.partitionBy("part", "conv").orderBy("row")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = ranged.groupBy("part", "conv").agg(F.count("*").alias("k")).select("part", "conv", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    return ranged.withColumn("at", F.row_number().over(own)).join(base, ["part", "conv"]).select("conv", (F.col("base") + F.col("at")).alias("place"), *TURN)


def rebuilt(placed: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(convs: conv, h; turns: conv, place and TURN): the first h = crc32(conv) % most turns come from conversation conv - conv % block."""
    convs = placed.select("conv").distinct().withColumn("h", F.crc32(F.col("conv").cast("string")) % most)
    needs = convs.where("h > 0").withColumn("base", F.col("conv") - F.col("conv") % block)
    heads = placed.where(F.col("place") < most).select(F.col("conv").alias("base"), "place", *TURN)  # fewer than `most` turns a conversation, which fewer than 2 * block convs ask for
    first = needs.join(heads, "base").where("place <= h").select("conv", "place", *TURN)
    count = heads.groupBy("base").agg(F.max("place").alias("have"))
    shift = needs.join(count, "base", "left").select("conv", (F.coalesce(F.least("h", "have"), F.lit(0)) - F.col("h")).alias("shift"))
    own = placed.join(convs, "conv").where("place > h").drop("h").join(shift, "conv", "left")
    return convs, first.unionByName(own.select("conv", (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"), *TURN))


def prefixes(store: Store, turns: DataFrame) -> DataFrame:
    """conv, depth, d1, d2, p1, p2 (the parent's digest), chars, last of every turn (conv, place and TURN)."""
    hashed = turns.select("conv", "place", "chars", F.xxhash64("place", "c1", "c2").alias("t1"), F.xxhash64("c2", "c1", "place").alias("t2"))
    ranged = store.put(hashed.repartitionByRange("conv", "place").withColumn("part", F.spark_partition_id()), "hashed")
    xor = lambda c: F.call_function("bit_xor", F.col(c))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    every = Window.partitionBy("conv")
    sums = ranged.groupBy("part", "conv").agg(xor("t1").alias("s1"), xor("t2").alias("s2"), F.max("place").alias("top"))
    none = F.lit(0).cast("long")
    sums = sums.select("part", "conv", F.coalesce(xor("s1").over(before), none).alias("b1"), F.coalesce(xor("s2").over(before), none).alias("b2"), F.max("top").over(every).alias("top"))
    run = Window.partitionBy("part", "conv").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    full = ranged.withColumns({"r1": xor("t1").over(run), "r2": xor("t2").over(run)}).join(sums, ["part", "conv"])
    full = full.withColumns({"d1": F.col("r1").bitwiseXOR(F.col("b1")), "d2": F.col("r2").bitwiseXOR(F.col("b2"))})
    return full.select("conv", F.col("place").cast("long").alias("depth"), "d1", "d2", F.col("d1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("d2").bitwiseXOR(F.col("t2")).alias("p2"), "chars", (F.col("place") == F.col("top")).alias("last"))


def rolled_up(store: Store, nodes: DataFrame, sums: list[str]) -> DataFrame:
    """nodes (NODE, p1, p2, and sums) with each of sums added up over the node and all its descendants.

    A node of depth d points at an ancestor of depth d - 2^j after round j, if there is one.
    """
    deepest = nodes.agg(F.max("depth").alias("d")).first()["d"] or 0
    state = nodes.select(*NODE, *sums, F.col("p1").alias("a1"), F.col("p2").alias("a2"), (F.col("depth") - 1).alias("above"))
    step = 1
    while step <= deepest:
        points = F.col("above") >= 0
        came = state.where(points).groupBy(F.col("a1").alias("d1"), F.col("a2").alias("d2"), F.col("above").alias("depth")).agg(*[F.sum(c).alias(f"{c}_more") for c in sums])
        added = state.join(came, NODE, "left").select(*NODE, *[(F.col(c) + F.coalesce(f"{c}_more", F.lit(0))).alias(c) for c in sums], "a1", "a2", "above")
        added = store.put(added, f"sums-{step}")
        # Only pointers whose end has one of its own, step above, go on.
        on = ["a1", "a2", "above"]
        ends = state.where(F.col("above") >= 0).select(F.col("d1").alias("a1"), F.col("d2").alias("a2"), F.col("depth").alias("above"), F.col("a1").alias("n1"), F.col("a2").alias("n2"))
        moving = added.where(F.col("above") >= step)
        jumped = spread_join(store, moving, ends, on).withColumns({"a1": F.col("n1"), "a2": F.col("n2"), "above": F.col("above") - step}).select(*added.columns)
        state = store.put(jumped.unionByName(added.where(F.col("above") < step).withColumns({"above": F.lit(-1).cast("long")})), f"pointers-{step}")
        step *= 2
    return state.select(*NODE, *sums)


def digests(ends: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ends_sha256: the SHA-256 of the ids (conv) of each key, in order, joined by commas.

    Ranges of ids become strings of up to CHUNK ids; a key's strings meet in one task, which holds one of them at a time.
    """
    ranged = ends.repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv").select(*keys, "conv")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            start = 0
            out = []
            for i in range(1, len(rows) + 1):
                if i == len(rows) or any(rows[i][k] != rows[start][k] for k in keys):
                    run = rows[start:i]
                    out.append((*[run[0][k] for k in keys], run[0]["conv"], ",".join(str(r["conv"]) for r in run)))
                    start = i
            if out:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*out))[:-1]), pa.array([r[-1] for r in out], pa.string())], [*keys, "first", "ids"])

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = own, hashlib.sha256()
                sha.update(row["ids"].encode())
            if out:
                yield told(out)
        if key is not None:
            yield told([(*key, sha.hexdigest())])

    def told(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], [*keys, "ends_sha256"])

    named = ", ".join(f"{k} long" for k in keys)
    strings = ranged.mapInArrow(chunks, f"{named}, first long, ids string")
    return strings.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(feed, f"{named}, ends_sha256 string")


def prefix_trie(spark: SparkSession, conversations: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node, from conversations (conv_id, turn, role, text)."""
    store = Store(spark, "prefix-trie")
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", own("role"), own("text"))
    placed = store.put(ordered_turns(store, turns), "placed")
    convs, again = rebuilt(placed, block, most)
    convs = store.put(convs.select("conv"), "convs")
    steps = store.put(prefixes(store, again), "prefixes")

    met = steps.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("chars").alias("chars"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(zero.alias("d1"), zero.alias("d2"), zero.alias("depth"), "conv_id", "n_convs", F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("chars"))
    nodes = store.put(met.unionByName(root), "nodes")
    up = [F.col("p1").alias("d1"), F.col("p2").alias("d2"), (F.col("depth") - 1).alias("depth")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    nodes = store.put(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)), "with-children")

    leaf = (F.col("n_children") == 0).cast("long").alias("n_leaves")
    sums = rolled_up(store, nodes.select(*NODE, "p1", "p2", leaf, ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])

    whole = steps.where("last").select(*NODE, "conv").unionByName(convs.join(steps.select("conv").distinct(), "conv", "left_anti").select(zero.alias("d1"), zero.alias("d2"), zero.alias("depth"), "conv"))
    shas = digests(whole, NODE)
    inner = nodes.where("depth > 0").withColumns({"q1": F.col("p1"), "q2": F.col("p2"), "qd": F.col("depth") - 1})
    named = nodes.select(F.col("d1").alias("q1"), F.col("d2").alias("q2"), F.col("depth").alias("qd"), F.col("conv_id").alias("parent_conv_id"))
    linked = spread_join(store, inner.select(*NODE, "q1", "q2", "qd"), named, ["q1", "q2", "qd"]).select(*NODE, "parent_conv_id")
    out = nodes.join(sums, NODE).join(linked, NODE, "left").join(shas, NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
