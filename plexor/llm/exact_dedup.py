"""Exact deduplication on an extendible-hash index kept in shared files.

Keys are 64-bit hashes of the normalised text (each run of ``[\\x20\\x09-\\x0D]`` is one space).

1. Copies are pre-aggregated into one entry a key, map-side first, so a text that a third of
   all rows share is one entry of its bucket.
2. The directory starts with one bucket and doubles while some bucket holds more than
   `capacity` keys.  A slot is what the first 16 bits of a key name; its local depth is the
   fewest leading bits that leave its buckets small enough, so only overfull buckets split.
   Depth has no limit but the key's 64 bits; the directory has a row a slot, 65,536 at most.
3. Owner tasks hold ranges of buckets.  Hashes never decide alone: the distinct texts under
   each key with more than one row are brought to the owner, which compares their bytes and
   chains those that differ.  Its entries are the index, written to shared files by range.
4. Each row looks its bucket up in the directory and finds its entry there.  Entries of
   over 1/4096 of all rows (4096 at most) come to the rows; other rows go to the owners.

Defined cases: null text counts as empty; rows with null doc_id take part, and stay only if
no row of the group has an id; of repeated rows (same id, same text) exactly one stays; an
empty table gives an empty result; texts of any length are hashed and compared whole;
further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexor.llm.store import Store, without, with_ids

SPACES = r"[\x20\x09-\x0D]+"
SLOT_BITS = 16
#: A key that this share of all rows has is answered where the rows are.
HOT = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def directory(loads: dict[int, int], capacity: int, bits: int = SLOT_BITS) -> dict[int, int]:
    """Local depth of every slot in use; bits + 1 where its one bucket must split further.

    loads: keys by slot, 2^bits of them at most.
    """
    by = {bits: dict(loads)}
    for d in range(bits - 1, -1, -1):
        by[d] = {}
        for slot, n in by[d + 1].items():
            by[d][slot >> 1] = by[d].get(slot >> 1, 0) + n
    return {slot: next((d for d in range(bits + 1) if by[d][slot >> (bits - d)] <= capacity), bits + 1) for slot in loads}


def slot_of(h: Column, bits: int = SLOT_BITS) -> Column:
    return F.shiftrightunsigned(h, 64 - bits)


def bucket_of(h: Column, depth: Column) -> Column:
    """The first `depth` bits of h; buckets of different depth share no keys, so depth and prefix name one."""
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", h, (64 - depth).cast("int")))


def depths(spark: SparkSession, hashes: DataFrame, capacity: int, bits: int = SLOT_BITS) -> DataFrame:
    """slot, depth of every slot in use."""
    slot = slot_of(F.col("h"), bits)
    loads = {r["slot"]: r["n"] for r in hashes.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).collect()}  # 2^bits rows at most
    found = directory(loads, capacity, bits)
    # No fewer bits can do than those that an even split needs.
    open_ = {s: bits + max(1, (-(-loads[s] // capacity) - 1).bit_length()) for s, d in found.items() if d > bits}
    while open_:
        at = spark.createDataFrame(list(open_.items()), "slot long, depth int")
        deep = hashes.withColumn("slot", slot).join(F.broadcast(at), "slot").groupBy("slot", bucket_of(F.col("h"), F.col("depth")).alias("bucket")).agg(F.count("*").alias("n"))
        most = {r["slot"]: r["most"] for r in deep.groupBy("slot").agg(F.max("n").alias("most")).collect()}  # 2^bits rows at most
        found |= {s: d for s, d in open_.items() if most[s] <= capacity or d == 64}
        open_ = {s: d + 1 for s, d in open_.items() if most[s] > capacity and d < 64}
    return spark.createDataFrame(list(found.items()), "slot long, depth int")


def placed(df: DataFrame, slots: DataFrame, bits: int = SLOT_BITS) -> DataFrame:
    """df with the depth and bucket of each row's key h, looked up in the directory."""
    found = df.withColumn("slot", slot_of(F.col("h"), bits)).join(F.broadcast(slots), "slot")  # 2^bits rows at most
    return found.withColumn("bucket", bucket_of(F.col("h"), F.col("depth"))).drop("slot")


def build_index(spark: SparkSession, docs: DataFrame, capacity: int = 16_384, slot_bits: int = SLOT_BITS, key_chars: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys: a row for each document; directory; index: a row for each distinct text), all in shared files.

    key_chars: leading hex digits of the SHA-256 that the key is made from; fewer only to test collisions.
    """
    store = Store(spark, "extendible-hash")
    raw = F.xxhash64("text")
    hashed = lambda df: df.withColumn("sha", F.sha2("body", 256)).withColumn("h", F.xxhash64(F.substring("sha", 1, key_chars)))
    plain = docs.select("doc_id", raw.alias("raw"), normalised(F.col("text")).alias("body"))
    keys = store.put(hashed(plain).select("doc_id", F.monotonically_increasing_id().alias("row"), "raw", "h", "sha", F.lit(0).alias("chain")), "keys")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    hashes = store.put(keys.groupBy("h").agg(first, F.count("*").alias("group_size")), "hashes")
    slots = store.put(depths(spark, hashes, capacity, slot_bits), "directory")

    # Owner tasks: one row for each distinct text under a key survives map-side.
    shared = hashes.where("group_size > 1").select("h")
    copied = store.put(with_ids(keys, shared, ["h"]).select("raw").distinct(), "copied")
    bodies = hashed(with_ids(docs.select(raw.alias("raw"), "text"), copied, ["raw"]).select(normalised(F.col("text")).alias("body")))
    bodies = placed(bodies, slots, slot_bits).groupBy("bucket", "h", "body").agg(F.count("*").alias("n"))
    owner = Window.partitionBy("bucket", "h").orderBy("body")
    chained = bodies.repartitionByRange("bucket", "h").select("h", "body", F.row_number().over(owner).alias("chain"))
    collided = store.put(chained.where("chain > 1").select("h").distinct(), "collided")
    if not collided.isEmpty():
        chains = with_ids(chained, collided, ["h"])
        again = docs.select("doc_id", raw.alias("raw"), normalised(F.col("text")).alias("body"), F.monotonically_increasing_id().alias("row"))
        apart = with_ids(hashed(again), collided, ["h"]).join(chains, ["h", "body"])
        keys = store.put(with_ids(keys, collided, ["h"], "left_anti").unionByName(apart.select("doc_id", "row", "raw", "h", "sha", "chain")), "chained-keys")
    single = with_ids(hashes, collided, ["h"], "left_anti").withColumn("chain", F.lit(0))
    several = with_ids(keys, collided, ["h"]).groupBy("h", "chain").agg(first, F.count("*").alias("group_size"))
    entries = placed(single.unionByName(several), slots, slot_bits).repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h", "chain")
    index = store.put(entries.select("bucket", "depth", "h", "chain", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"), "index")
    return keys, slots, index


def verdicts(spark: SparkSession, docs: DataFrame, slot_bits: int = SLOT_BITS, **options) -> DataFrame:
    """doc_id, raw (hash of the text as it is), keep_id, group_size, kept, text_sha256 of every row of docs."""
    keys, slots, index = build_index(spark, docs, slot_bits=slot_bits, **options)
    on = ["bucket", "depth", "h", "chain"]
    probes = placed(keys, slots, slot_bits)
    rows = index.agg(F.sum("group_size").alias("n")).first()["n"] or 0
    hot = index.where(F.col("group_size") * HOT > rows)  # fewer than HOT entries
    near = probes.join(F.broadcast(hot), on)
    far = probes.join(F.broadcast(hot.select(on)), on, "left_anti").join(index.where(F.col("group_size") * HOT <= rows), on)
    kept = F.col("row") == F.col("keep_row")
    return near.unionByName(far).select("doc_id", "raw", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text)."""
    return verdicts(spark, docs, **options).drop("raw")


def dropped_copies(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs without the rows whose normalised text another row has that stays; all columns stay."""
    return without(docs, verdicts(spark, docs, **options))
