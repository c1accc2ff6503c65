"""Written tables that cut the lineage of iterative plans."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset (tests, a laptop)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plexor-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read again: later steps start from files that outlive executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.settled_at = at
    return out


def forgotten(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def swept(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go once the driver collects what refers to them, which it seldom does on its own, as it fills little memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A key that more than this share of all rows has is joined by broadcast; there are fewer such keys than this.
HOT = 4096


def spread_join(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with other (written, one row a key); keys of more than 1/HOT of the rows, which are counted, come to the rows."""
    counts = rows.groupBy(*on).agg(F.count("*").alias("k"))
    hot = settled(counts.where(F.col("k") * HOT > rows.count()).select(*on), "hot")  # fewer than HOT keys
    near = rows.join(F.broadcast(other.join(F.broadcast(hot), on)), on)
    return near.unionByName(rows.join(F.broadcast(hot), on, "left_anti").join(other, on))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, on any file system that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
