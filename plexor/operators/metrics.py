"""Quality of partitions and scores.  labels: node, label.  Undefined values are null."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexor.operators.graph import places
from plexor.sources.tables import settled


def labelled(both: DataFrame, labels: DataFrame) -> DataFrame:
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
    return both.join(of("u"), "u").join(of("v"), "v")


def modularity(canonical: DataFrame, labels: DataFrame) -> DataFrame:
    """layer, modularity: sum over communities of inside / m - (degree / 2m)^2, from u < v edges."""
    met = labelled(canonical, labels)
    ends = met.select("layer", F.explode(F.array(F.struct(F.col("lu").alias("label"), "w", F.when(F.col("lu") == F.col("lv"), F.col("w")).otherwise(0.0).alias("inside")), F.struct(F.col("lv").alias("label"), "w", F.lit(0.0).alias("inside")))).alias("e"))
    return _modularity(ends.groupBy("layer", "e.label").agg(F.sum("e.inside").alias("inside"), F.sum("e.w").alias("degree")))


def grouped_modularity(members: DataFrame, layers: DataFrame, labels: DataFrame) -> DataFrame:
    """modularity() of layers whose edges join the members of a group, by the number of groups that two share (factor.grouped_spmm), without making the edges.

    Members meet labels by node, then their group; k members of one label in a group of n have k (k - 1) / 2 edges inside and k (n - 1) ends.
    """
    met = members.select("group", "node").repartition("node").distinct().join(labels.select("node", "label"), "node")
    alike = met.repartition("group").groupBy("group", "label").agg(F.count("*").cast("double").alias("k"))
    full = alike.join(layers.select("group", "layer").repartition("group").distinct(), "group")
    full = full.withColumn("n", F.sum("k").over(Window.partitionBy("group", "layer"))).where("n > 1")
    return _modularity(full.groupBy("layer", "label").agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("inside"), F.sum(F.col("k") * (F.col("n") - 1)).alias("degree")))


def _modularity(per: DataFrame) -> DataFrame:
    """layer, modularity from layer, label, inside, degree."""
    whole = per.groupBy("layer").agg(F.sum("inside").alias("inside"), F.sum("degree").alias("both"), F.sum(F.pow("degree", F.lit(2))).alias("squares"))
    return whole.select("layer", (2 * F.col("inside") / F.nullif("both", F.lit(0.0)) - F.col("squares") / F.pow(F.nullif("both", F.lit(0.0)), F.lit(2))).alias("modularity"))


def mean_modularity(per_layer: DataFrame) -> DataFrame:
    return per_layer.agg(F.avg(F.nanvl("modularity", F.lit(None).cast("double"))).alias("modularity"))


def conductance(canonical: DataFrame, labels: DataFrame) -> DataFrame:
    """layer, conductance: the mean over communities that are neither empty nor everything; weights don't count."""
    met = labelled(canonical, labels)
    ends = met.select("layer", F.explode(F.array("lu", "lv")).alias("label"), (F.col("lu") != F.col("lv")).cast("long").alias("cut"))
    per = ends.groupBy("layer", "label").agg(F.sum("cut").alias("cut"), F.count("*").alias("volume"))
    # A community without an edge in a layer adds nothing there, but counts.
    valid = labels.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") < labels.count())
    volumes = per.groupBy("layer").agg(F.sum("volume").alias("all"))  # a row for each layer
    full = per.join(valid, "label").join(F.broadcast(volumes), "layer").withColumn("rest", F.col("all") - F.col("volume"))
    least = F.least("volume", "rest")
    cut = F.col("cut") / F.when(least > 0, least).otherwise(1)
    return full.groupBy("layer").agg((F.sum(cut) / F.lit(valid.count())).alias("conductance"))


def contingency(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("node", F.col("label").alias("a")).join(right.select("node", F.col("label").alias("b")), "node").groupBy("a", "b").agg(F.count("*").alias("k"))


def _groups(table: DataFrame, *by: str) -> DataFrame:
    """by, side, k: sizes of the cells ("ab") and of both sides' groups of a contingency table, in one pass."""
    none = lambda c: F.lit(None).cast(table.schema[c].dataType).alias(c)
    sides = F.array(
        F.struct(F.lit("ab").alias("side"), F.col("a"), F.col("b")),
        F.struct(F.lit("a").alias("side"), F.col("a"), none("b")),
        F.struct(F.lit("b").alias("side"), none("a"), F.col("b")),
    )
    return table.select(*by, F.explode(sides).alias("s"), "k").groupBy(*by, "s.side", "s.a", "s.b").agg(F.sum("k").cast("double").alias("k"))


def _nmi(table: DataFrame, *by: str) -> DataFrame:
    of = lambda side, value: F.sum(F.when(F.col("side") == side, value))
    weigh = F.col("k") * F.log("k")
    sums = _groups(table, *by).groupBy(*by).agg(of("ab", F.col("k")).alias("n"), *[of(x, weigh).alias(f"e{x}") for x in ("ab", "a", "b")], *[of(x, F.lit(1)).alias(f"n{x}") for x in ("a", "b")])
    entropy = lambda x: F.log("n") - F.col(f"e{x}") / F.col("n")
    both = entropy("a") + entropy("b")
    return sums.select(*by, F.when((F.col("na") > 1) | (F.col("nb") > 1), F.greatest(2 * (both - entropy("ab")) / both, F.lit(0.0))).otherwise(1.0).alias("nmi"))


def nmi(table: DataFrame) -> DataFrame:
    """nmi of a contingency table (a, b, k), normalised by the mean of both entropies; 1 if both are a single group."""
    return _nmi(table)


def pairwise_nmi(runs: DataFrame) -> DataFrame:
    """r1, r2, nmi of every two runs (run, node, label)."""
    two = runs.select(F.col("run").alias("r2"), "node", F.col("label").alias("b"))
    met = runs.select(F.col("run").alias("r1"), "node", F.col("label").alias("a")).join(two, "node").where("r1 < r2")
    return _nmi(met.groupBy("r1", "r2", "a", "b").agg(F.count("*").alias("k")), "r1", "r2")


def ari(table: DataFrame) -> DataFrame:
    """Adjusted Rand index of a contingency table (a, b, k); 1 where chance decides nothing."""
    pairs = F.col("k") * (F.col("k") - 1) / 2
    of = lambda side, value: F.sum(F.when(F.col("side") == side, value))
    row = _groups(table).agg(of("ab", F.col("k")).alias("n"), of("ab", pairs).alias("s"), of("a", pairs).alias("sa"), of("b", pairs).alias("sb"))
    expected = F.col("sa") * F.col("sb") / F.nullif(F.col("n") * (F.col("n") - 1) / 2, F.lit(0.0))
    top = (F.col("sa") + F.col("sb")) / 2 - expected
    return row.select(F.when(top != 0, (F.col("s") - expected) / top).otherwise(1.0).alias("ari"))


def auc(scores: DataFrame) -> DataFrame:
    """auc of scores (y 0 or 1, score): tied scores count half; null without both kinds.

    Ranks come from counts by score and a running sum over score ranges, so no task holds all rows.
    """
    by = scores.groupBy("score").agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))
    ranged = settled(by.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "scores")
    parts = ranged.groupBy("part").agg(F.sum("neg").alias("neg"))
    below = parts.select("part", F.coalesce(F.sum("neg").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("base"))  # a row for each partition
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    won = ranged.withColumn("under", inside).join(F.broadcast(below), "part")
    sums = won.agg(F.sum(F.col("pos") * (F.col("base") + F.col("under") + F.col("neg") / 2)).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p") * F.col("n"))).alias("auc"))


def gathered(runs: DataFrame, metrics: list[str], *by: str) -> DataFrame:
    """mean and population deviation of each metric over runs, without NaN."""
    clean = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    return runs.groupBy(*by).agg(*[f for c in metrics for f in (F.avg(clean(c)).alias(f"{c}_mean"), F.stddev_pop(clean(c)).alias(f"{c}_std"))])


def communities(labels: DataFrame) -> DataFrame:
    """label, size of every community that has a node."""
    return labels.groupBy("label").agg(F.count("*").alias("size"))


def sizes(labels: DataFrame, k: int) -> DataFrame:
    """label, size of 0 to k - 1, absent labels with 0."""
    return labels.sparkSession.range(k).select(F.col("id").cast("int").alias("label")).join(communities(labels), "label", "left").fillna(0, ["size"])


def relabelled(labels: DataFrame) -> DataFrame:
    """Labels renumbered from 0 in their order; the distinct labels are put in order by ranges."""
    return labels.join(places(labels.select("label").distinct(), F.col("label"), "label", "new"), "label").select("node", F.col("new").alias("label"))
