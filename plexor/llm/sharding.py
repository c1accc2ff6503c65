"""Sharding by vector bin packing.

Documents with equal texts form a group with a demand vector (bytes, tokens, rows).  Each
group goes to the shard where the dot product of its demand with the shard's residual
capacity is highest, all three measured as shares of the corpus.  Groups that hold over a
quarter of a shard are split into chunks by a hash of the id, since no placing of them
whole could balance; at most 3 * 4 * shards groups are that large.

Placing is sequential, so it is done in three steps that stay bounded: units of over
1/4096 of the corpus (at most 3 * 4096) are placed first in one task; the residual
capacity is then divided among cells of about `cell_units` units each, and the cells place
the rest independently, in descending order of demand.  An error of a cell is at most its
last, smallest units.  Ids, sizes and hashes are all that is shuffled, never texts.

Defined cases: null text has no bytes, no tokens and CRC 0, and is a group of its own; repeated rows are rows of
one group, each with a slot; a very long text is a unit of its own, measured whole; null
ids sort first; an empty table gives an empty result; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexor.llm.store import Store

WORD = r"[^\x20\x09-\x0D]++"
LARGE = 4096


def place(demand: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The shard of each demand, in order; residual (shards x dimensions) is used up."""
    out = np.empty(len(demand), np.int32)
    for i, d in enumerate(demand):
        out[i] = s = int(np.argmax(residual @ d))
        residual[s] -= d
    return out


def shard(spark: SparkSession, docs: DataFrame, shards: int = 16, cell_units: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of docs (doc_id, text)."""
    store = Store(spark, "sharding")
    text = F.coalesce("text", F.lit(""))
    rows = store.put(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
            F.xxhash64(F.col("text").isNull(), text).alias("key"),
        ),
        "rows",
    )
    vector = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*vector).first()
    all_of = [max(1, total[c] or 0) for c in ("size", "tokens", "rows")]
    share = lambda c, n: F.col(c) / F.lit(float(n))
    most = F.greatest(*[share(c, n) for c, n in zip(("size", "tokens", "rows"), all_of)])
    pieces = F.least(F.col("rows"), F.ceil(most * 4 * shards))

    groups = rows.groupBy("key", "text_crc32").agg(*vector)
    hot = store.put(groups.withColumn("pieces", pieces).where((most > 1 / (4 * shards)) & (F.col("pieces") > 1)).select("key", "text_crc32", "pieces"), "hot")
    chunk = F.coalesce(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.col("pieces")), F.lit(0))
    rows = rows.join(F.broadcast(hot), ["key", "text_crc32"], "left").withColumn("chunk", chunk)  # at most 12 * shards rows
    units = store.put(rows.groupBy("key", "text_crc32", "chunk").agg(*vector).withColumn("most", most), "units")

    dims = list(zip(("size", "tokens", "rows"), all_of))
    kind = "key long, text_crc32 long, chunk long, shard int"

    def placed(pdf: pd.DataFrame, residual: np.ndarray) -> pd.DataFrame:
        pdf = pdf.sort_values(["most", "key", "text_crc32", "chunk"], ascending=[False, True, True, True])
        demand = np.column_stack([pdf[c].to_numpy(float) / n for c, n in dims])
        return pdf[["key", "text_crc32", "chunk"]].assign(shard=place(demand, residual))

    large = store.put(
        units.where(F.col("most") > 1 / LARGE).withColumn("cell", F.lit(0)).groupBy("cell").applyInPandas(lambda pdf: placed(pdf, np.full((shards, 3), 1.0 / shards)), kind),
        "large",
    )
    used = np.zeros((shards, 3))
    for r in units.join(large, ["key", "text_crc32", "chunk"]).groupBy("shard").agg(*vector).collect():
        used[r["shard"]] = [r[c] / n for c, n in dims]
    small = units.where(F.col("most") <= 1 / LARGE)
    cells = max(1, -(-small.count() // cell_units))
    left = (1.0 / shards - used) / cells

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        return placed(pdf, left.copy())

    others = small.withColumn("cell", F.pmod(F.xxhash64("key", "chunk"), F.lit(cells))).groupBy("cell").applyInPandas(rest, kind)
    homes = store.put(large.unionByName(others), "homes")

    parts = max(16, (total["rows"] or 0) // (100_000 * shards))
    settled = store.put(
        rows.join(homes, ["key", "text_crc32", "chunk"]).select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(2)), F.lit(parts)).alias("part")),
        "settled",
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settled.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("shard", "part", "base")
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        settled.withColumn("at", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("at") + F.col("base")).cast("long").alias("slot"))
    )


def read_shard(sharded: DataFrame, number: int) -> Iterator:
    """The doc_ids of one shard in slot order."""
    return (r["doc_id"] for r in sharded.where(F.col("shard") == number).orderBy("slot").toLocalIterator())
