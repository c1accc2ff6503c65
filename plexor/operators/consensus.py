"""Consensus over runs: co-association of nodes, thresholds, communities of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexor.operators.cluster import louvain, with_isolated
from plexor.operators.graph import hashed
from plexor.sources.tables import settled, spread_join


#: Rows of a cluster that one key of the join holds of either side.
CELL = 512


def coassociation(runs: DataFrame, cell: int = CELL) -> DataFrame:
    """u, v, c for u < v: the share of runs (run, node, label) in which both have the same label.

    Quadratic in cluster size by definition; coassociation_sampled() bounds it.  A cluster of more
    than `cell` nodes is cut into cells by hash, and every two of its cells, and each with itself, meet under
    a key of their own: no key has more than some 2 * cell rows, however large a cluster is.
    """
    n = runs.select("run").distinct().count()
    return _pairs(runs, cell).groupBy("u", "v").agg((F.count("*") / F.lit(n)).alias("c"))


def celled(runs: DataFrame, cell: int) -> DataFrame:
    """run, label, node, cell, and a row for each pair of cells (low <= high) that the node's cell is in."""
    cells = settled(runs.groupBy("run", "label").agg(F.ceil(F.count("*") / cell).cast("long").alias("cells")), "cells")
    dealt = spread_join(runs.select("run", "label", "node"), cells, ["run", "label"]).withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")))
    met = dealt.select("run", "label", "node", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("other"))
    return met.select("run", "label", "node", "cell", F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high"))


def _pairs(runs: DataFrame, cell: int) -> DataFrame:
    dealt, key = celled(runs, cell), ["run", "label", "low", "high"]
    left = dealt.withColumnsRenamed({"node": "u", "cell": "cu"})
    right = dealt.withColumnsRenamed({"node": "v", "cell": "cv"})
    return left.join(right, key).where("u < v and (low = high or cu <> cv)").select("run", "u", "v")


def written(pairs: DataFrame, path: str) -> DataFrame:
    """Pairs stored in ranges of c, so that a threshold reads only the files and row groups that reach it."""
    pairs.repartitionByRange("c").sortWithinPartitions("c").write.mode("overwrite").parquet(path)
    return pairs.sparkSession.read.schema(pairs.schema).parquet(path)


def coassociation_sampled(runs: DataFrame, most_exact: int = 2000, most_pairs: int = 200_000, seed: int = 0) -> DataFrame:
    """As coassociation(), but of clusters over most_exact only about most_pairs pairs, drawn by hash without repetition.

    A large cluster is cut into as many hash cells as leave about that many pairs within cells; pairs within a cell are the sample.
    """
    n = runs.select("run").distinct().count()
    size = runs.groupBy("run", "label").agg(F.count("*").alias("m"))
    pairs = F.col("m") * (F.col("m") - 1) / 2
    cells = size.select("run", "label", F.when(F.col("m") <= most_exact, 1).otherwise(F.ceil(pairs / most_pairs)).cast("long").alias("cells"))
    cell = F.conv(F.substring(hashed(seed, "run", "node"), 1, 12), 16, 10).cast("long") % F.col("cells")
    dealt = spread_join(runs, settled(cells, "cells"), ["run", "label"]).withColumn("cell", cell)
    right = dealt.select("run", "label", "cell", F.col("node").alias("v"))
    met = dealt.select("run", "label", "cell", F.col("node").alias("u")).join(right, ["run", "label", "cell"]).where("u < v")
    return met.groupBy("u", "v").agg((F.count("*") / F.lit(n)).alias("c"))


def above(pairs: DataFrame, threshold: float) -> DataFrame:
    """Strictly above the threshold."""
    return pairs.where(F.col("c") > threshold)


def reaching(pairs: DataFrame, threshold: float) -> DataFrame:
    """At the threshold or above; all pairs if none reaches it."""
    best = pairs.agg(F.max("c").alias("top"))  # one row
    return pairs.join(F.broadcast(best)).where((F.col("c") >= threshold) | (F.col("top") < threshold)).drop("top")


def consensus_communities(pairs: DataFrame, nodes: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """node, label of all nodes; without any edge every node has label 0."""
    kept = above(pairs, threshold) if strict else reaching(pairs, threshold)
    graph = kept.select(F.lit("consensus").alias("layer"), "u", "v", F.col("c").alias("w"))
    if graph.isEmpty():
        return nodes.select("node", F.lit(0).cast("long").alias("label"))
    return with_isolated(louvain(graph), nodes)
