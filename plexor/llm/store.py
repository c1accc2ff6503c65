"""Tables in the folder that all executors share, joins by keys, and scans of texts.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset and Spark runs
in one process (tests, a laptop) is a folder of our own chosen.  Writing a table there cuts
lineage: a lost executor costs the re-read of a file, never a recomputation of what led to it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plexor-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_opened: list[list[Store]] = []


class Store:
    """One operator run's written tables."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        for stores in _opened:
            stores.append(self)

    def put(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Writes df and returns the written table."""
        self.n += 1
        at = f"{self.path}/{self.n:03d}-{name}"
        df.write.options(**options).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out.store_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes written tables that nothing reads any more."""
        for df in tables:
            self._delete(df.store_path)

    def close(self) -> None:
        """Deletes all tables of this run; what was made from them must have been written."""
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def closing() -> Iterator[None]:
    """Closes the stores that are opened inside, at the end; what is wanted of them must be written elsewhere by then."""
    stores: list[Store] = []
    _opened.append(stores)
    try:
        yield
    finally:
        _opened.pop()
        for store in stores:
            store.close()


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that are over: it does so once both garbage collectors have seen them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Keys that may be broadcast: at most a million rows of numbers.  A hashed relation takes up to some 40 bytes a row and 8 a column, so 64 MB.
BROADCAST_KEYS = 1_000_000
_FIXED = {"bigint", "int", "boolean", "double", "smallint", "tinyint"}


def with_ids(df: DataFrame, ids: DataFrame, on: list[str], how: str = "left_semi", most: int = BROADCAST_KEYS) -> DataFrame:
    """df joined with a table of numbers: broadcast if counted to be at most `most` rows, else by shuffle."""
    wide = [c for c, kind in ids.dtypes if kind not in _FIXED]
    if wide or len(ids.columns) > 4:
        raise ValueError(f"rows of {ids.columns} have no small fixed width")
    small = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if small else ids, on, how)


#: A key that more than this share of all rows has is joined by broadcast; there are fewer such keys than this.
HOT = 4096


def spread_join(store: Store, rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with other (one row a key); keys of more than 1/HOT of the rows, which are counted, come to the rows."""
    counts = rows.groupBy(*on).agg(F.count("*").alias("k"))
    total = rows.count()
    hot = store.put(counts.where(F.col("k") * HOT > total).select(*on), "hot")  # fewer than HOT keys
    near = rows.join(F.broadcast(other.join(F.broadcast(hot), on)), on)
    far = rows.join(F.broadcast(hot), on, "left_anti").join(other, on)
    return near.unionByName(far)


#: Bytes of an Arrow batch of texts, so that a task's memory doesn't grow with its rows' lengths; a longer text is a batch of its own.
BATCH = 2 << 20
_BATCH_BYTES, _UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def scan(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow() in batches of BATCH bytes, unless the session has its own bound."""
    spark = df.sparkSession
    if spark.conf.get(_BATCH_BYTES) == _UNSET:
        spark.conf.set(_BATCH_BYTES, str(BATCH))
    return df.mapInArrow(each, schema)


def free(df: DataFrame, name: str) -> str:
    """The name, or one like it that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def without(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """docs without the rows that are not kept, by verdict: doc_id, raw, kept of every row of docs.

    raw is ``xxhash64(text)``.  Rows alike in doc_id and text can't be told apart: of those, all
    go or stay, or exactly one stays if only one is kept.
    """
    store = Store(docs.sparkSession, "without")
    key = lambda raw: [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)).cast("long"), raw]
    names = [free(docs, n) for n in ("__none", "__id", "__raw")]
    named = lambda raw: [c.alias(n) for c, n in zip(key(raw), names)]
    gone = store.put(verdict.where(~F.col("kept")).select(*named(F.col("raw"))).distinct(), "gone")
    marked = docs.select("*", *named(F.xxhash64("text")))
    out = with_ids(marked, gone, names, "left_anti")
    repeated = store.put(with_ids(verdict.where("kept").select(*named(F.col("raw"))), gone, names).distinct(), "repeated")
    if not repeated.isEmpty():
        out = out.unionByName(with_ids(marked, repeated, names).dropDuplicates(names))
    return out.select(*docs.columns)
