"""The document pipeline: toxicity, exact dedup, near-dedup, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result
is written as Parquet and read again for the next one. All stages but the last return the columns
of documents.

Defined cases: null texts count as empty and pass the toxicity stage by their score; of equal texts, empty
ones included, one document stays; rows that repeat id and text are one document; extra columns are
carried along, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import exact_dedup, packing, simhash, suffix_dedup, toxicity
from seriesloom.llm.common import Scratch, table
from seriesloom.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.keep_clean(docs, table(ship_package(spark), sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those whose texts are equal without white space."""
    return exact_dedup.keep_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group whose fingerprints link; shingle length and bit distance are the operator's own."""
    ship_package(spark)
    return simhash.keep_rows(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that also occur elsewhere."""
    ship_package(spark)
    return suffix_dedup.cut_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the training sequences they go to."""
    ship_package(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

# training a classifier and fingerprints have no counterpart in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(ship_package(spark), "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
