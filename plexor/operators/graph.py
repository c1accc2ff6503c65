"""Node sets and layers of a multiplex graph.

Edges are (layer, u, v, w); "canonical" edges have u < v, "both" holds each in both directions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexor.sources.tables import settled


def node_set(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def layer_nodes(edges: DataFrame) -> DataFrame:
    return edges.select("layer", F.explode(F.array("u", "v")).alias("node")).distinct()


def common_nodes(edges: DataFrame, layers: int | None = None) -> DataFrame:
    """Nodes with an edge in every layer; layers: how many there are, counted if not given."""
    per = layer_nodes(edges).groupBy("node").agg(F.count("*").alias("k"))
    if layers is not None:
        return per.where(F.col("k") == layers).select("node")
    count = edges.agg(F.countDistinct("layer").alias("layers"))
    return per.join(F.broadcast(count), per["k"] == count["layers"]).select("node")  # one row


def node_index(nodes: DataFrame) -> DataFrame:
    """node, idx: places from 0 in string order, without a task that holds all nodes.

    Nodes are sorted by ranges; a range's offset is the number of nodes in those before it.
    """
    return places(nodes.select("node").distinct(), F.col("node").cast("string"), "node", "idx")


def places(rows: DataFrame, order: Column, key: str, name: str) -> DataFrame:
    """key, name: places from 0 of rows in a total order."""
    ranged = settled(rows.select(key, order.alias("at")).repartitionByRange("at").select(key, "at", F.spark_partition_id().alias("part")), "ranged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count("*").alias("k")).select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1
    return ranged.withColumn("place", place).join(F.broadcast(offsets), "part").select(key, (F.col("base") + F.col("place")).alias(name))


def restricted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among nodes."""
    return edges.join(nodes.select(F.col("node").alias("u")), "u", "left_semi").join(nodes.select(F.col("node").alias("v")), "v", "left_semi").select(edges.columns)


def indexed(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Edges between indexed nodes, as indices."""
    of = lambda end: index.select(F.col("node").alias(end), F.col("idx").alias(f"{end}_idx"))
    return edges.join(of("u"), "u").join(of("v"), "v").drop("u", "v").withColumnsRenamed({"u_idx": "u", "v_idx": "v"})


def no_loops(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v")


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; a loop stays once.  Edges are read, and what makes them is planned, once."""
    there, back = F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    rest = [c for c in edges.columns if c not in ("u", "v")]
    turned = edges.select(*rest, F.explode(F.when(F.col("u") != F.col("v"), F.array(there, back)).otherwise(F.array(there))).alias("ends"))
    return turned.select(*[F.col(f"ends.{c}") if c in ("u", "v") else F.col(c) for c in edges.columns])


def upper(edges: DataFrame) -> DataFrame:
    return edges.where("u < v")


def clipped(edges: DataFrame) -> DataFrame:
    """Duplicates count once, with weight 1."""
    return edges.select("layer", "u", "v").distinct().withColumn("w", F.lit(1.0))


def summed(edges: DataFrame) -> DataFrame:
    """Duplicates add up."""
    return edges.groupBy("layer", "u", "v").agg(F.sum("w").alias("w"))


def degrees(both: DataFrame) -> DataFrame:
    """layer, node, degree (weighted), links (unweighted)."""
    return both.groupBy("layer", F.col("u").alias("node")).agg(F.sum("w").alias("degree"), F.count("*").alias("links"))


def entries(both: DataFrame) -> DataFrame:
    """layer, nnz: stored entries."""
    return both.groupBy("layer").agg(F.count("*").alias("nnz"))


def layer_weights(nnz: DataFrame, method: str, nodes: int, custom: dict[str, float] | None = None, total: str = "layers") -> DataFrame:
    """layer, weight.  total: weights sum to the number of layers, or to 1 ("one"); all zero: equal.

    Methods: none, inv_nnz, sqrt_inv_nnz, degree_inv, uniform, custom (one for every layer).
    """
    count = F.greatest(F.col("nnz"), F.lit(1)).cast("double")
    if method == "custom":
        have = {r["layer"] for r in nnz.select("layer").collect()}  # a row for each layer
        if not custom or set(custom) != have:
            raise ValueError("custom weights must name every layer once")
        raw = F.coalesce(*[F.when(F.col("layer") == k, F.lit(float(v))) for k, v in custom.items()])
    elif method in ("none", "uniform"):
        raw = F.lit(1.0)
    elif method == "inv_nnz":
        raw = 1.0 / (F.col("nnz") + 1e-9) if total == "one" else 1.0 / count
    elif method == "sqrt_inv_nnz":
        raw = 1.0 / F.sqrt(count)
    elif method == "degree_inv":
        raw = 1.0 / F.greatest(F.col("nnz") / F.lit(float(nodes)), F.lit(1e-6))
    else:
        raise ValueError(f"unknown method {method}")
    if method == "none":
        return nnz.select("layer", raw.alias("weight"))
    every = Window.partitionBy(F.lit(1))  # layers, not edges
    whole = F.sum("raw").over(every)
    to = F.count("*").over(every) if total == "layers" else F.lit(1.0)
    return nnz.withColumn("raw", raw).select("layer", F.when(whole > 0, F.col("raw") / whole * to).otherwise(to / F.count("*").over(every)).alias("weight"))


def scaled_layers(edges: DataFrame, weights: DataFrame) -> DataFrame:
    return edges.join(F.broadcast(weights), "layer").select("layer", "u", "v", (F.col("w") * F.col("weight")).alias("w"))  # a row for each layer


def aggregate_layers(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """u, v, w of the weighted sum of the layers."""
    return scaled_layers(edges, weights).groupBy("u", "v").agg(F.sum("w").alias("w"))


def symmetric_normalised(both: DataFrame) -> DataFrame:
    """w over the root of both ends' degrees (at least 1), without loops."""
    deg = degrees(both).select("layer", "node", F.greatest("degree", F.lit(1.0)).alias("d"))
    of = lambda end: deg.select("layer", F.col("node").alias(end), F.col("d").alias(f"d_{end}"))
    return no_loops(both).join(of("u"), ["layer", "u"]).join(of("v"), ["layer", "v"]).select("layer", "u", "v", (F.col("w") / F.sqrt(F.col("d_u") * F.col("d_v"))).alias("w"))


def hashed(seed: int, *columns: str) -> Column:
    """A seeded order that other engines can follow: MD5 of the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def sampled_nodes(nodes: DataFrame, most: int, seed: int = 0) -> DataFrame:
    return nodes.orderBy(hashed(seed, "node"), "node").limit(most)


def held_out(canonical: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """layer, u, v of max(1, floor(share * m)) edges of each layer; none of a layer with at most one edge, or without a share."""
    if share <= 0:
        return canonical.select("layer", "u", "v").limit(0)
    return sampled_edges(canonical, share, seed, smallest=2)


def sampled_edges(canonical: DataFrame, share: float, seed: int = 0, smallest: int = 1) -> DataFrame:
    """layer, u, v of max(1, floor(share * m)) edges of each layer of at least `smallest` edges.

    The cut is found on counts by hash prefix, so only the edges of one prefix in each layer are ordered one by one.
    """
    keyed = canonical.select("layer", "u", "v", hashed(seed, "layer", "u", "v").alias("key")).withColumn("prefix", F.substring("key", 1, 3))
    counts = keyed.groupBy("layer", "prefix").agg(F.count("*").alias("k"))
    every = Window.partitionBy("layer")
    run = every.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    want = F.when(F.sum("k").over(every) >= smallest, F.greatest(F.lit(1), F.floor(F.sum("k").over(every) * F.lit(share)))).otherwise(0)
    plan = counts.select("layer", "prefix", F.coalesce(F.sum("k").over(run), F.lit(0)).alias("before"), want.alias("want")).where("before < want")
    place = F.row_number().over(Window.partitionBy("layer", "prefix").orderBy("key", "u", "v"))
    return keyed.join(plan, ["layer", "prefix"]).withColumn("place", place).where("before + place <= want").select("layer", "u", "v")


def without(canonical: DataFrame, gone: DataFrame) -> DataFrame:
    return canonical.join(gone, ["layer", "u", "v"], "left_anti")


def free_pairs(pairs: DataFrame, canonical: DataFrame) -> DataFrame:
    """Pairs (u < v) that no edge joins."""
    return pairs.join(canonical.select("u", "v"), ["u", "v"], "left_anti")


def negative_pairs(canonical: DataFrame, index: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """u, v: `count` pairs of distinct nodes that no edge joins, from index (node, idx from 0); a pair may come twice.

    Pairs are drawn by hash until there are enough, each time as many as the share of free
    pairs asks for; only a graph without a free pair ends with none.
    """
    spark, n = canonical.sparkSession, index.count()
    joined = restricted(upper(canonical).select("u", "v").distinct(), index).count()
    share = (n * (n - 1) - 2 * joined) / max(n * n, 1)  # of all draws
    draw = lambda salt: F.pmod(F.xxhash64("id", F.lit(f"{seed}:{salt}")), F.lit(max(n, 1)))
    of = lambda at, end: index.select(F.col("idx").alias(at), F.col("node").alias(end))
    found, have, start = None, 0, 0
    while share > 0 and have < count:
        stop = start + int((count - have) / share * 1.1) + 100
        drawn = spark.range(start, stop).select("id", draw("u").alias("a"), draw("v").alias("b")).where("a <> b")
        pairs = drawn.join(of("a", "x"), "a").join(of("b", "y"), "b").select("id", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
        more = settled(free_pairs(pairs, canonical).select("id", "u", "v"), "negatives")
        found, have, start = more if found is None else found.unionByName(more), have + more.count(), stop
    if found is None:
        return canonical.select("u", "v").limit(0)
    return _first(found, count).select("u", "v")


def _first(rows: DataFrame, count: int) -> DataFrame:
    """The `count` rows of least id (unique, long); only the block of ids that holds the cut is put in order."""
    rows = rows.withColumn("block", F.shiftright("id", 16))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.count("*").alias("k")).select("block", "k", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))  # a row for 65,536 draws
    cut = blocks.where(F.col("before") + F.col("k") >= count).orderBy("block").limit(1).first()
    if cut is None:
        return rows
    return rows.where(F.col("block") < cut["block"]).unionByName(rows.where(F.col("block") == cut["block"]).orderBy("id").limit(count - cut["before"]))
