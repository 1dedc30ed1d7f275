"""Ordered hold-out split and error metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.quality import DEFAULT_PERIOD
from seriesloom.panel import KEY, attach, lengths

MAPE_FLOOR = 1e-8


def split(panel: DataFrame, ratio: float = 0.8, seasons: DataFrame | None = None) -> DataFrame:
    """Add n, n_train, is_train and the season length of each series (12 when unknown)."""
    sizes = lengths(panel).withColumn("n_train", F.floor(F.col("n") * F.lit(float(ratio))))
    if seasons is None:
        sizes = sizes.withColumn("season", F.lit(DEFAULT_PERIOD))
    else:
        sizes = sizes.join(seasons.select(KEY, F.col("seasonal_period").alias("season")), KEY, "left").withColumn(
            "season", F.coalesce(F.col("season").cast("int"), F.lit(DEFAULT_PERIOD))
        )
    sizes = sizes.withColumn("last_i", F.col("n") - 1)
    return attach(panel.select(KEY, "ts", "i", "y"), sizes).withColumn("is_train", F.col("i") < F.col("n_train"))


def train_rows(parts: DataFrame) -> DataFrame:
    return parts.where("is_train")


def holdout_rows(parts: DataFrame) -> DataFrame:
    return parts.where("not is_train").withColumn("h", F.col("i") - F.col("n_train") + 1)


def metrics(forecasts: DataFrame) -> DataFrame:
    """mae, rmse, mape, r2 per series and model from rows with y and yhat."""
    y, error = F.col("y"), F.col("y") - F.col("yhat")
    sums = forecasts.groupBy(KEY, "model").agg(
        F.count("*").alias("points"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (100 * F.avg(F.abs(error) / F.greatest(F.abs(y), F.lit(MAPE_FLOOR)))).alias("mape"),
        F.sum(error * error).alias("sse"),
        (F.var_pop(y) * F.count(y)).alias("total"),
    )
    flat = F.when(F.col("sse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("total") > 0, 1 - F.try_divide(F.col("sse"), F.col("total"))).otherwise(flat)
    return sums.select(KEY, "model", "points", "mae", "rmse", "mape", r2.alias("r2"))


def rank_models(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rank by mae within a series; a series has a handful of models."""
    order = Window.partitionBy(KEY, *(by or [])).orderBy("mae", "model")
    return scores.withColumn("rank", F.row_number().over(order)).withColumn("is_best", F.col("rank") == 1)


def metrics_frame(ranked: DataFrame) -> DataFrame:
    """Long chart frame with the best model flagged."""
    return ranked.unpivot([KEY, "model", "is_best"], ["mae", "rmse", "mape", "r2"], "metric", "value")
