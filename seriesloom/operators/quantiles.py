"""Exact linear-interpolated quantiles per series, safe for one huge series.

The built-in exact percentile keeps every distinct value of a group in one task. Here a
sketch brackets the wanted rank first; rows outside the bracket fold into one counter
before the shuffle, so a window only orders the distinct values inside the bracket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.panel import KEY, attach

ACCURACY = 10_000
SLACK = 4.0 / ACCURACY
SALTS = 16


def quantiles(
    df: DataFrame, want: Mapping[str, float], value: str = "y", keys: Sequence[str] = (KEY,)
) -> DataFrame:
    """One row per key with a column for each name in ``want`` (name -> probability).

    Rows that carry their position also give ``last_i``, for attaching the result to them.
    """
    keys = list(keys)
    placed = "i" in df.columns and keys == [KEY]
    extra = ["i"] if placed else []
    source = df.select(*keys, *extra, F.col(value).cast("double").alias("v"))
    # the last position counts rows without a value too
    tail = [F.max("i").alias("last_i")] if placed else []
    lows = [max(0.0, p - SLACK) for p in want.values()]
    highs = [min(1.0, p + SLACK) for p in want.values()]
    marks = source.groupBy(*keys).agg(
        F.count("v").alias("n"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        F.percentile_approx("v", lows + highs, ACCURACY).alias("marks"),
        *tail,
    )
    source = source.where(F.col("v").isNotNull()).withColumn("weight", F.lit(1).cast("long"))
    whole = F.col("n") <= ACCURACY
    brackets = [
        F.struct(
            F.lit(name).alias("name"),
            F.lit(float(p)).alias("p"),
            F.when(whole, F.col("least")).otherwise(F.col("marks")[j]).alias("lo"),
            F.when(whole, F.col("most")).otherwise(F.col("marks")[j + len(want)]).alias("hi"),
        )
        for j, (name, p) in enumerate(want.items())
    ]
    reach = ["last_i"] if placed else []
    spec = marks.select(*keys, *reach, "n", F.inline(F.array(*brackets)))
    if placed:
        met = attach(source, spec.withColumn("end_i", F.col("last_i")))
        reach = ["end_i"]
    else:
        salt = F.pmod(F.xxhash64("v"), F.lit(SALTS))
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        # equal values fold first, so that a value shared by many rows does not fill one salt
        folded = source.groupBy(*keys, "v").agg(F.sum("weight").alias("weight"))
        met = folded.withColumn("salt", salt.cast("int")).join(spec.withColumn("salt", salts), [*keys, "salt"])
    inside = F.col("v") >= F.col("lo")
    counted = (
        met.where(F.col("v") <= F.col("hi"))
        .withColumn("v", F.when(inside, F.col("v")))
        .groupBy(*keys, *reach, "name", "p", "n", "v")
        .agg(F.sum("weight").alias("rows"))
    )
    # the null row counts everything below the bracket and sorts first
    order = Window.partitionBy(*keys, "name").orderBy(F.col("v").asc_nulls_first())
    upto = F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rank = F.col("p") * (F.col("n") - 1)
    ranked = counted.withColumn("upto", upto).withColumn("rank", rank)
    covers = lambda r: (r >= F.col("upto") - F.col("rows")) & (r < F.col("upto"))
    lower, upper = F.floor("rank"), F.ceil("rank")
    picked = ranked.groupBy(*keys, *reach, "name", "rank").agg(
        F.max(F.when(covers(lower), F.col("v"))).alias("a"), F.max(F.when(covers(upper), F.col("v"))).alias("b")
    )
    value_at = F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == name, value_at)).alias(name) for name in want],
        *([F.max("end_i").alias("last_i")] if placed else []),
    )
