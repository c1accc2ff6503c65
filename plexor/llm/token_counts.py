"""Token counts of flat, unindexed token files by scanning for separators.

A file is one run of 16-bit (or 32-bit) token ids; documents end with the end-of-document
id and nothing else tells where they begin.  Files are read in blocks.  Each block is
searched for separators at once (one vector comparison) and leaves a summary: its tokens,
its first and last separator, and the lengths of the documents that lie wholly inside.
Documents that cross blocks are stitched by a prefix scan of the summaries: a running sum
gives each block's place in the file, a running maximum the last separator before it.  The
scan is done in segments of blocks and then over the segments, so no task holds a whole
file's summaries, however long it is.

Defined cases: a document may be empty (two separators in a row); tokens after the last
separator are a document that is not terminated; an empty file has no documents; null and
empty texts make empty documents; a document of any length may span any number of blocks;
repeated rows are documents each; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexor.llm.store import Store, scan
from plexor.llm.tokens import token_table
from plexor.llm.words import slabs
from plexor.sources.archives import FileRanges, loaded

BLOCK = 1 << 20
SEGMENT = 256
EMPTY = pa.array([], pa.int64())


def token_files(docs: DataFrame, path: str, eod: int, block: int = BLOCK) -> DataFrame:
    """file, block, data, docs: the flat 16-bit token stream of each task, cut into blocks of `block` bytes wherever they fall.

    docs holds the ids of the documents in the order in which they stand, in the rows of each
    file in which the writer had them; only the caller that wants ids for counts needs it.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, file, number, held, names = token_table(path, special=False), TaskContext.get().partitionId(), 0, [], []

        def row(data: bytes) -> pa.RecordBatch:
            nonlocal number, names
            out = pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([data], pa.binary()), pa.array([names], pa.list_(pa.int64()))], ["file", "block", "data", "docs"])
            number, names = number + 1, []
            return out

        size = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for slab in slabs(batch.column(1)):
                tokens, bounds = table.ids(slab)
                stream = np.insert(tokens.astype("<u2"), bounds[1:], eod)
                names += ids[slab.first : slab.first + len(slab)]
                held.append(stream.tobytes())
                size += len(held[-1])
                if size >= block:
                    data = b"".join(held)
                    whole = len(data) // block * block
                    for at in range(0, whole, block):
                        yield row(data[at : at + block])
                    held, size = [data[whole:]], len(data) - whole
        if size or names:
            yield row(b"".join(held))

    return scan(docs.select("doc_id", "text"), write, "file long, block long, data binary, docs array<long>")


def file_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """name, file, block, data of real flat files, each range read for itself; block: bytes, a multiple of a token's."""
    found = loaded(spark, FileRanges, path, range=block)
    return found.select(F.col("path").alias("name"), F.xxhash64("path").alias("file"), (F.col("start") / block).cast("long").alias("block"), F.col("content").alias("data"))


def summaries(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """file, block, n_tokens, n_ends, first_end, last_end, inner of each block; places count from the block's start.

    inner: start and length of each document that lies wholly inside.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, number, data in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = np.frombuffer(data, f"<u{width}")
                ends = np.flatnonzero(tokens == eod)
                some = len(ends) > 0
                arrays = [[file], [number], [len(tokens)], [len(ends)], [int(ends[0]) if some else None], [int(ends[-1]) if some else None]]
                inner = pa.ListArray.from_arrays(pa.array([0, max(0, len(ends) - 1)], pa.int32()), pa.StructArray.from_arrays([pa.array(ends[:-1] + 1), pa.array(np.diff(ends) - 1)], ["at", "n"]))
                yield pa.RecordBatch.from_arrays([*(pa.array(a, pa.int64()) for a in arrays), inner], ["file", "block", "n_tokens", "n_ends", "first_end", "last_end", "inner"])

    return scan(blocks.select("file", "block", "data"), search, "file long, block long, n_tokens long, n_ends long, first_end long, last_end long, inner array<struct<at: long, n: long>>")


def stitch(found: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """file, ordinal, start, n_tokens, terminated of every document, from the summaries (a written table)."""
    found = found.withColumn("segment", F.floor(F.col("block") / segment))
    inside = Window.partitionBy("file", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(-1)
    local = found.select(
        "*",
        F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n_ends").over(inside), F.lit(0)).alias("rank"),
    ).withColumn("before", F.max(F.col("base") + F.col("last_end")).over(inside))
    totals = local.groupBy("file", "segment").agg(F.sum("n_tokens").alias("tokens"), F.sum("n_ends").alias("ends"), F.max(F.col("base") + F.col("last_end")).alias("last"))
    shifted = totals.select(
        "*",
        F.coalesce(F.sum("tokens").over(across), F.lit(0)).alias("seg_base"),
        F.coalesce(F.sum("ends").over(across), F.lit(0)).alias("seg_rank"),
    )
    shifted = shifted.withColumn("seg_before", F.coalesce(F.max(F.col("seg_base") + F.col("last")).over(across), none))
    placed = local.join(shifted, ["file", "segment"]).select(
        "file",
        "block",
        "n_tokens",
        "n_ends",
        "first_end",
        "last_end",
        "inner",
        (F.col("seg_base") + F.col("base")).alias("base"),
        (F.col("seg_rank") + F.col("rank")).alias("rank"),
        F.coalesce(F.col("seg_base") + F.col("before"), "seg_before").alias("before"),
    )
    first = placed.where("n_ends > 0").select("file", F.col("rank").alias("ordinal"), (F.col("before") + 1).alias("start"), (F.col("base") + F.col("first_end") - F.col("before") - 1).alias("n_tokens"), F.lit(True).alias("terminated"))
    runs = placed.where("n_ends > 1").select("file", "rank", "base", F.posexplode("inner").alias("i", "one"))
    inner = runs.select("file", (F.col("rank") + F.col("i") + 1).alias("ordinal"), (F.col("base") + F.col("one.at")).alias("start"), F.col("one.n").alias("n_tokens"), F.lit(True).alias("terminated"))
    last = placed.groupBy("file").agg(F.sum("n_tokens").alias("all"), F.sum("n_ends").alias("ordinal"), F.max(F.col("base") + F.col("last_end")).alias("end"))
    start = F.coalesce(F.col("end"), none) + 1
    rest = last.where(start < F.col("all")).select("file", "ordinal", start.alias("start"), (F.col("all") - start).alias("n_tokens"), F.lit(False).alias("terminated"))
    return first.unionByName(inner).unionByName(rest)


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, eod: int = 49407) -> DataFrame:
    """doc_id, file, ordinal, start, n_tokens of every document, counted from the token files that are written for docs."""
    store = Store(spark, "token-files")
    files = store.put(token_files(docs, path, eod), "tokens", compression="zstd")
    found = store.put(summaries(files, eod), "summaries")
    names = files.select("file", "block", F.size("docs").cast("long").alias("n"), "docs")
    held = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    named = names.withColumn("from", F.coalesce(F.sum("n").over(held), F.lit(0))).select("file", "from", F.posexplode("docs").alias("i", "doc_id"))
    named = named.select("file", (F.col("from") + F.col("i")).alias("ordinal"), "doc_id")
    return named.join(stitch(found), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
