"""Fitted parameters as tables: save, load, and score on new data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.forecast import additive, arima, ets, naive, slots
from seriesloom.panel import KEY, attach

Fitted = DataFrame | slots.TreeModel
PREDICTORS: dict[str, Callable[[Fitted, DataFrame], DataFrame]] = {
    "SARIMA": arima.predict,
    "ARIMA": arima.predict,
    "Prophet": additive.predict,
    "Exponential Smoothing": ets.predict,
    "STL + ETS (Hybrid)": ets.predict,
    "Seasonal Naive": naive.predict,
    "XGBoost": slots.predict,
}


def safe_name(name: str) -> str:
    return name.replace(" ", "_").lower()


def save_model(params: Fitted, root: str, name: str) -> str:
    path = f"{root}/{safe_name(name)}"
    if isinstance(params, slots.TreeModel):
        params.save(path)
    else:
        params.write.mode("overwrite").parquet(path)
    return path


def load_model(spark: SparkSession, root: str, name: str) -> Fitted:
    path = f"{root}/{safe_name(name)}"
    try:
        return slots.TreeModel.load(spark, path) if safe_name(name) == safe_name("XGBoost") else spark.read.parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"No saved model at {path}") from error


def _predictor(name: str, params: Fitted):
    for known, predict in PREDICTORS.items():
        if safe_name(known) == safe_name(name):
            if (predict is slots.predict) != isinstance(params, slots.TreeModel):
                raise ValueError(f"these parameters are not those of {known}")
            return predict
    raise ValueError(f"{name} has no stored forecast")


def score_saved(params: Fitted, name: str, panel: DataFrame, trained_rows: DataFrame) -> DataFrame:
    """Forecast as many steps as each new series has rows, and pair actual with predicted.

    ``trained_rows`` (series_id, n_train) says where the fitted series ended; step 1 follows it.
    """
    future = attach(panel.select(KEY, "ts", "y", "i", (F.col("i") + 1).alias("h")), trained_rows)
    future = future.withColumn("i", F.col("n_train") + F.col("h") - 1)
    made = _predictor(name, params)(params, future)
    return future.select(KEY, "h", "ts", F.col("y").alias("actual")).join(
        made.select(KEY, "h", F.col("yhat").alias("predicted")), [KEY, "h"]
    )


def next_steps(params: Fitted, name: str, lengths: DataFrame, steps: int = 30) -> DataFrame:
    """Forecast the ``steps`` periods after training; ``lengths`` has series_id, n_train, last_ts, gap_seconds."""
    rows = lengths.withColumn("h", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(steps).cast("long"))))
    rows = rows.withColumn("i", F.col("n_train") + F.col("h") - 1).withColumn(
        "ts",
        F.timestamp_micros(
            F.unix_micros(F.col("last_ts").cast("timestamp"))
            + (F.col("h") * F.coalesce(F.col("gap_seconds"), F.lit(0.0)) * 1e6).cast("long")
        ).cast("timestamp_ntz"),
    )
    return _predictor(name, params)(params, rows.select(KEY, "ts", "i", "h"))
