"""Fit forecasters on a hold-out split, compare and rank them."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.forecast import additive, arima, boosted, ets, hybrid, naive, slots
from seriesloom.operators.forecast.split import metrics, rank_models, split, holdout_rows, train_rows
from seriesloom.panel import KEY
from seriesloom.session import written

FAST = ["SARIMA", "Prophet", "XGBoost"]
ALL = [
    "SARIMA",
    "ARIMA",
    "Prophet",
    "Exponential Smoothing",
    "XGBoost",
    "STL + ETS (Hybrid)",
    "ARIMA + ETS + GBDT (Hybrid)",
]
ONE_STEP = {"XGBoost"}


@dataclass
class Run:
    """Forecast rows (with y), one status row per series, and fitted parameters where they exist."""

    name: str
    forecasts: DataFrame
    status: DataFrame
    params: dict[str, DataFrame | slots.TreeModel] = field(default_factory=dict)


class Bench:
    """One split shared by all models; parameters are written once and reused by the hybrids.

    ``lags`` of the trees: one list for all series, or rows (series_id, recommended_lags) with lags per series.
    """

    def __init__(
        self,
        panel: DataFrame,
        ratio: float = 0.8,
        seasons: DataFrame | None = None,
        lags: Sequence[int] | DataFrame = boosted.DEFAULT_LAGS,
        rounds: int = boosted.ROUNDS,
    ):
        self.ratio, self.lags, self.rounds = ratio, lags, rounds
        self.parts = written(split(panel, ratio, seasons), "split")
        self.train, self.future = train_rows(self.parts), holdout_rows(self.parts)
        self._fitted: dict[str, DataFrame] = {}

    def params(self, name: str) -> DataFrame:
        fits = {
            "SARIMA": lambda: arima.fit(self.train, seasonal=True),
            "ARIMA": lambda: arima.fit(self.train),
            "Prophet": lambda: additive.fit(self.train),
            "Exponential Smoothing": lambda: ets.fit(self.train),
            "STL + ETS (Hybrid)": lambda: hybrid.fit_seasonal_ets(self.train),
            "Seasonal Naive": lambda: naive.fit(self.train),
        }
        if name not in self._fitted:
            self._fitted[name] = written(fits[name](), "params")
        return self._fitted[name]

    def run(self, name: str) -> Run:
        # a row per step on both sides: neither is to be broadcast, however small its file
        y = self.future.select(KEY, "i", "y").hint("merge")
        every = self.parts.select(KEY).distinct()
        if name == "XGBoost" and isinstance(self.lags, DataFrame):
            model, rows = slots.fit(self.parts, self.lags, self.ratio, self.rounds)
            status = model.params.select(KEY, F.lit(name).alias("model"), "status", "error")
            return Run(name, self._named(rows, name), status, {name: model})
        if name == "XGBoost":
            rows, _ = boosted.fit_predict(self.parts, self.lags, self.ratio, self.rounds)
            return Run(name, self._named(rows, name), self._status(every, rows, name, "too few rows for the lags"))
        if name == "ARIMA + ETS + GBDT (Hybrid)":
            one, two = self.params("ARIMA"), self.params("Exponential Smoothing")
            rows = hybrid.predict_boosted(self.parts, one, two, self.rounds).join(y, [KEY, "i"])
            rows = written(rows, "hybrid")
            return Run(name, self._named(rows, name), self._status(every, rows, name, "ARIMA or smoothing failed"))
        params = self.params(name)
        predict = {
            "SARIMA": arima.predict,
            "ARIMA": arima.predict,
            "Prophet": additive.predict,
            "Seasonal Naive": naive.predict,
        }.get(name, ets.predict)
        rows = predict(params, self.future).join(y, [KEY, "i"])
        status = every.join(params.select(KEY, "status", "error"), KEY, "left").select(
            KEY,
            F.lit(name).alias("model"),
            F.coalesce("status", F.lit("failed")).alias("status"),
            F.when(F.col("status").isNull(), "no training rows").otherwise(F.col("error")).alias("error"),
        )
        return Run(name, self._named(rows, name), status, {name: params})

    def _named(self, rows: DataFrame, name: str) -> DataFrame:
        mode = "one-step" if name in ONE_STEP else "multi-step"
        return rows.select(KEY, F.lit(name).alias("model"), F.lit(mode).alias("mode"), "h", "ts", "i", "y", "yhat")

    @staticmethod
    def _status(every: DataFrame, rows: DataFrame, name: str, error: str) -> DataFrame:
        done = rows.select(KEY).distinct().withColumn("done", F.lit(True))
        return every.join(done, KEY, "left").select(
            KEY,
            F.lit(name).alias("model"),
            F.when(F.col("done"), "success").otherwise("failed").alias("status"),
            F.when(F.col("done").isNull(), error).alias("error"),
        )


@dataclass
class Comparison:
    forecasts: DataFrame
    scores: DataFrame
    failed: DataFrame
    bench: Bench


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _kept(bench: Bench, name: str) -> Run:
    """A run whose forecasts are written: one plan for those of all models would hold all their broadcast tables at once."""
    run = bench.run(name)
    return replace(run, forecasts=written(run.forecasts, "forecast"))


def compare(bench: Bench, models: Sequence[str] | None = None) -> Comparison:
    """Run the models, keep the successful ones, rank by mae over all and within each mode.

    The many short jobs of the trees run beside the other models, which share nothing with them.
    """
    names = list(models or FAST)
    with ThreadPoolExecutor(1) as beside:
        begun = {name: beside.submit(inheritable_thread_target(_kept), bench, name) for name in names if name in ONE_STEP}
        done = {name: _kept(bench, name) for name in names if name not in begun}
        done |= {name: run.result() for name, run in begun.items()}
    runs = [done[name] for name in names]
    forecasts = _union([r.forecasts for r in runs])
    modes = F.when(F.col("model").isin(sorted(ONE_STEP)), "one-step").otherwise("multi-step")
    scored = rank_models(metrics(forecasts)).withColumn("mode", modes)
    scored = rank_models(scored.withColumnRenamed("rank", "overall").withColumnRenamed("is_best", "best"), ["mode"])
    scores = scored.select(
        KEY, "model", "mode", "points", "mae", "rmse", "mape", "r2",
        F.col("overall").alias("rank"), F.col("best").alias("is_best"), F.col("rank").alias("rank_in_mode"),
    )
    failed = _union([r.status for r in runs]).where("status = 'failed'")
    return Comparison(forecasts, scores, failed, bench)


def forecast_frame(bench: Bench, forecasts: DataFrame) -> DataFrame:
    """Actual against forecast, only for models that cover the whole test part."""
    sizes = bench.parts.select(KEY, (F.col("n") - F.col("n_train")).alias("n_test")).distinct()
    counts = forecasts.groupBy(KEY, "model").agg(F.count("*").alias("points"))
    whole = counts.join(sizes, KEY).where("points = n_test").select(KEY, "model")
    actual = bench.future.select(KEY, "i", "ts", F.col("y").alias("actual"))
    rows = forecasts.join(whole, [KEY, "model"]).select(KEY, "i", "model", "yhat")
    return actual.join(rows, [KEY, "i"]).select(KEY, "ts", "actual", "model", "yhat")
