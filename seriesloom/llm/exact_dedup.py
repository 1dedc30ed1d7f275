"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is normalised by deleting all white space and cut into chunks where its own characters say
so (CHUNK). A chunk's identifier is its 64-bit hash; the distinct chunks of every hash are counted
by their full content, so a hash that stands for two chunks is found, and such chunks get a
second identifier, their rank among the chunks of that hash. Texts are equal exactly when their
ordered identifier lists are. A text crosses the network once, as its distinct chunks; everything
after that works on short lists.

Of equal texts, the row with the most code points in its original text stays, then the smallest
doc_id (null last), then the first row. Defined cases: null counts as empty, and all empty texts
are equal; rows that repeat a doc_id are rows like any other, so only one of them stays when their
texts are equal; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.llm.common import BLANKS, Scratch, keyed, rows_by_key, salted_left_join

# at least 512 code points, then up to the next early-letter late-letter pair, at most 4,096
CHUNK = r"(?s).{512,4094}?[a-m][n-z]|.{1,4096}"


def normalised(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(normalised(text), F.lit(CHUNK), F.lit(0))


def decide(docs: DataFrame, identifier: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the row key (kd, kt), one row per row of docs."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = keyed(docs)
    recipes = scratch.write(
        rows.select(
            "doc_id", "kd", "kt",
            F.monotonically_increasing_id().alias("row"),
            F.length("text").alias("n_chars"),
            F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256"),
            F.transform(_chunks(F.col("text")), lambda c: identifier(c)).alias("recipe"),
        ),
        "recipes",
    )
    chunks = rows.select("kd", "kt", F.posexplode(_chunks(F.col("text"))).alias("at", "chunk")).withColumn("h", identifier(F.col("chunk")))
    ambiguous = scratch.write(
        chunks.groupBy("h", "chunk").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "ambiguous"
    )
    recipes = recipes.withColumn("ranks", F.array().cast("array<struct<at:int,rank:int>>"))
    if not ambiguous.isEmpty():
        touched = chunks.join(ambiguous, "h", "left_semi")
        ranked = touched.select("h", "chunk").distinct().withColumn("rank", F.row_number().over(W.partitionBy("h").orderBy("chunk")))
        ranks = touched.join(ranked, ["h", "chunk"]).groupBy("kd", "kt").agg(F.sort_array(F.collect_set(F.struct("at", "rank"))).alias("found"))
        recipes = scratch.write(
            recipes.join(ranks, ["kd", "kt"], "left").withColumn("ranks", F.coalesce("found", "ranks")).drop("found"), "ranked-recipes"
        )
    order = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "row")
    groups = recipes.groupBy("recipe", "ranks").agg(F.count("*").alias("group_size"), F.min(order).alias("best")).where("group_size > 1")
    joined = salted_left_join(recipes, groups, ["recipe", "ranks"], F.col("row"), many=True)
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
        "text_sha256", "kd", "kt",
    )


def keep_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    # rows with one key repeat id and text: one of them stays
    return rows_by_key(docs, decide(docs).where("kept"))
