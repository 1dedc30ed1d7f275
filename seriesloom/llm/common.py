"""Row keys, scratch tables and salted joins shared by the operators of this package."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.session import workspace

# the white space of all word and line rules: blank, tab, line feed, vertical tab, form feed, return
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id as decimal text, modulo divisor; null ids give null."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % divisor


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the row key (kd, kt).

    The key never is null, and two rows share it only if they repeat both id and text, so
    whatever is found out about one of them holds for the other.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = F.col("doc_id").cast("long")
    return docs.select(
        number.alias("doc_id"),
        text.alias("text"),
        F.coalesce(number, F.lit(0)).alias("kd"),
        F.xxhash64(number, text).alias("kt"),
    )


def rows_by_key(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose key (kd, kt) is in stay; one row for each key."""
    number, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the columns travel as one struct, so none of them can clash with the key
    marked = docs.select(F.struct("*").alias("rest"), F.coalesce(number, F.lit(0)).alias("kd"), F.xxhash64(number, text).alias("kt"))
    return marked.join(stay.select("kd", "kt"), ["kd", "kt"], "left_semi").dropDuplicates(["kd", "kt"]).select("rest.*")


class Scratch:
    """Tables of one run in the shared folder; drop() deletes what no later step reads.

    A written table ends the use of the shuffle files behind it. Spark deletes such files once the
    driver has collected the plan that made them, so write() asks for a collection.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{workspace(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        schema = df.schema
        del df
        self.release()
        return self.spark.read.schema(schema).parquet(self.path(name))

    def release(self) -> None:
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffled(exploded: DataFrame) -> DataFrame:
    """For one side of a join: Spark sizes rows as they were before an explode and would broadcast many times its threshold."""
    return exploded.hint("merge")


def salted_join(
    rows: DataFrame, groups: DataFrame, keys: list[str], salt_from: Column, how: str = "inner", salts: int = 32, many: bool = False
) -> DataFrame:
    """Join of many rows with few rows per key; the rows of a hot key go to `salts` tasks. many: the groups grow with the rows."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(shuffled(right) if many else right, [*keys, "_salt"], how).drop("_salt")


def salted_left_join(
    rows: DataFrame, groups: DataFrame, keys: list[str], salt_from: Column, salts: int = 32, many: bool = False
) -> DataFrame:
    return salted_join(rows, groups, keys, salt_from, "left", salts, many)
