"""From raw documents to packed training sequences, stage by stage.

Each stage gets all that its predecessor kept, written as Parquet in the shared folder and
read again, so a lost executor never costs more than one stage.  A stage's own tables are
deleted once its result is written.

Defined cases, in every stage: null, empty and blank texts have no words, fail the quality
rules and go there; rows without an id are judged by their text as all others are, and stay
in a group only if no row with an id does; of repeated rows one stays; very long texts are
read whole; an empty table gives an empty one; all further columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plexor.llm.exact_dedup import dropped_copies
from plexor.llm.mixing import mixed_documents
from plexor.llm.ngram_join import first_of_groups
from plexor.llm.packing import pack_documents
from plexor.llm.quality_rules import kept_documents
from plexor.llm.queries import tokenizer_path
from plexor.llm.store import Store, closing, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the n-gram likelihood ratio reject go."""
    return kept_documents(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one with the smallest id stays."""
    return dropped_copies(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays."""
    return first_of_groups(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: left out, once, or as many rows as it repeats them."""
    return mixed_documents(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document, with its sequence and place there."""
    return pack_documents(spark, docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: The likelihood ratio, components, flow and packing are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = Store(spark, "pipeline")
    for name, stage in STAGES:
        with closing():
            docs = store.put(stage(spark, docs, sf_dir), name)
        release(spark)
    return docs
