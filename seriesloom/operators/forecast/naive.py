"""Repeat the last season, or the last value with a season of 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.panel import KEY, attach


def last_season(train: DataFrame, value: str = "y", season=None) -> DataFrame:
    """Per series the values of its last season, ordered by ``i mod season``."""
    m = F.col("season") if season is None else F.lit(season)
    tail = train.withColumn("season", m).where(F.col("i") >= F.col("n_train") - F.col("season"))
    items = F.array_sort(F.collect_list(F.struct((F.col("i") % F.col("season")).alias("phase"), F.col(value).alias("v"))))
    return tail.groupBy(KEY, "season").agg(F.transform(items, lambda s: s["v"]).alias("pattern"))


def fit(train: DataFrame, season=None) -> DataFrame:
    made = last_season(train, season=season)
    short = F.size("pattern") < F.col("season")
    return made.select(
        KEY,
        F.when(short, "failed").otherwise("success").alias("status"),
        F.when(short, "fewer rows than one season").alias("error"),
        "season",
        "pattern",
    )


def predict(params: DataFrame, future: DataFrame) -> DataFrame:
    rows = attach(future.select(KEY, "ts", "i", "h"), params.where("status = 'success'"))
    phase = (F.col("i") % F.col("season")).cast("int")
    return rows.select(KEY, "ts", "i", "h", F.get("pattern", phase).alias("yhat"))
