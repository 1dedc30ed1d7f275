"""Statistical profile: one row of features per series."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.mathx import student_t_two_sided
from seriesloom.operators.autocorr import from_sums, lag_features, lag_pass
from seriesloom.operators.decompose import component_variances, decompose, strength
from seriesloom.operators.quality import seasonal_period
from seriesloom.operators.quantiles import quantiles
from seriesloom.operators.stationarity import adf
from seriesloom.panel import KEY, attach
from seriesloom.session import written

TREND_PERIOD = 12
TREND_MIN_ROWS = 24


@F.pandas_udf(T.DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_t_two_sided(t.to_numpy(float), df.to_numpy(float)))


def _basic_columns():
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return [
        F.count("y").alias("dataset_size"),
        F.concat(stamp(F.min("ts")), F.lit(" to "), stamp(F.max("ts"))).alias("date_range"),
        (F.count_if(F.col("y").isNull()) / F.count("*") * 100).alias("missing_pct"),
        F.lit(True).alias("univariate"),
    ]


def _moment_columns():
    y = F.col("y")
    return [
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("std"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
        F.skewness(y).alias("skewness"),
        F.kurtosis(y).alias("kurtosis"),
        F.coalesce(F.try_divide(F.stddev_samp(y), F.avg(y)), F.lit(0.0)).alias("cv"),
    ]


def _line_columns():
    x, y = F.when(F.col("y").isNotNull(), F.col("i").cast("double")), F.col("y")
    return [
        F.regr_count(y, x).alias("points"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        # the built-in correlation raises on a flat series in ANSI mode
        F.try_divide(F.covar_pop(y, x), F.stddev_pop(y) * F.stddev_pop(x)).alias("r"),
    ]


def basic_features(panel: DataFrame) -> DataFrame:
    return panel.groupBy(KEY).agg(*_basic_columns())


def moment_features(panel: DataFrame) -> DataFrame:
    """Sample deviation; population skewness and excess kurtosis."""
    return panel.groupBy(KEY).agg(*_moment_columns())


def quantile_features(panel: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Median, and rows beyond the quartile fences."""
    marks = quantiles(panel, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    spread = threshold * (F.col("q3") - F.col("q1"))
    hit = (F.col("y") < F.col("q1") - spread) | (F.col("y") > F.col("q3") + spread)
    return (
        attach(panel, marks)
        .groupBy(KEY)
        .agg(
            F.first("median").alias("median"),
            F.count_if(hit).alias("outliers_count"),
            (F.count_if(hit) / F.count("*") * 100).alias("outlier_pct"),
        )
    )


def statistical_features(panel: DataFrame) -> DataFrame:
    return moment_features(panel).join(quantile_features(panel), KEY, "left")


def trend_line(panel: DataFrame) -> DataFrame:
    """Least squares of the value on its position; flat series have r = 0, short ones no fit."""
    return _tested_line(panel.groupBy(KEY).agg(*_line_columns()))


def _tested_line(fit: DataFrame) -> DataFrame:
    r = F.when(F.col("points") >= 2, F.coalesce(F.when(~F.isnan("r"), F.col("r")), F.lit(0.0)))
    dof = (F.col("points") - 2).cast("double")
    t = F.try_divide(r * F.sqrt(F.greatest(dof, F.lit(0.0))), F.sqrt(F.greatest(1 - r * r, F.lit(0.0))))
    return fit.select(
        KEY,
        "points",
        F.when(F.col("points") >= 2, F.col("slope")).alias("slope"),
        F.when(F.col("points") >= 2, F.col("intercept")).alias("intercept"),
        r.alias("r"),
        F.when(F.col("points") > 2, F.coalesce(t, F.when(F.abs(r) >= 1, F.lit(float("inf"))))).alias("t"),
        dof.alias("dof"),
    ).withColumn("p_value", F.when(F.col("points") > 2, t_tail("t", "dof")))


def trend_flags(line: DataFrame) -> DataFrame:
    slope = F.coalesce("slope", F.lit(0.0))
    return line.select(
        KEY,
        F.coalesce((F.abs(slope) > 0.01) & (F.col("p_value") < 0.05), F.lit(False)).alias("has_trend"),
        F.when(slope > 0, "upward").when(slope < 0, "downward").otherwise("none").alias("trend_direction"),
        slope.alias("trend_slope"),
        F.coalesce(F.col("r") * F.col("r"), F.lit(0.0)).alias("trend_linearity"),
    )


def trend_strength(panel: DataFrame, line: DataFrame) -> DataFrame:
    """From the decomposition with period 12, or the correlation where that is not possible."""
    parts = component_variances(decompose(panel, TREND_PERIOD))
    by_parts = strength(F.col("trend_var"), F.col("resid_var"))
    return line.join(parts, KEY, "left").select(
        KEY, F.coalesce(by_parts, F.abs("r"), F.lit(0.0)).alias("trend_strength")
    )


def seasonality_features(panel: DataFrame, frequencies: DataFrame) -> DataFrame:
    periods = frequencies.select(KEY, seasonal_period(F.col("frequency")).alias("period"))
    parts = component_variances(decompose(attach(panel, periods), "period"))
    share = F.coalesce(strength(F.col("seasonal_var"), F.col("resid_var")), F.lit(0.0))
    return periods.join(parts, KEY, "left").select(
        KEY,
        (share > 0.3).alias("has_seasonality"),
        F.when(share > 0.3, F.col("period")).cast("int").alias("seasonal_period"),
        share.alias("seasonality_strength"),
    )


CHANGES = ["mean_abs_change", "std_1st_diff", "zero_crossing_rate"]


def change_features(panel: DataFrame) -> DataFrame:
    """Mean absolute change, population deviation of changes, rate of crossings of the mean."""
    return lag_pass(panel, 1).select(KEY, *CHANGES)


def complexity(features: DataFrame) -> DataFrame:
    """Add data_complexity_score, 0 to 10."""
    points = [
        (F.col("has_trend"), 2),
        (F.col("has_seasonality"), 2),
        (~F.coalesce(F.col("is_stationary"), F.lit(False)), 1),
        (F.col("outlier_pct") > 5, 1),
        (F.col("dataset_size") > 1000, 2),
        (F.col("lag_1_acf") > 0.7, 1),
        (F.col("seasonality_strength") > 0.6, 1),
    ]
    total = sum((F.when(hit, F.lit(p)).otherwise(0) for hit, p in points), F.lit(0))
    return features.withColumn("data_complexity_score", F.least(F.lit(10), total).cast("int"))


def profile(panel: DataFrame, frequencies: DataFrame, adf_max_lag: int | None = None) -> DataFrame:
    """All features in one row per series. Frequencies may come from the raw data.

    The panel is read several times, so hand in a written table. One aggregation gives size,
    moments and trend line, one window pass all lag products and changes.

    Every part is written before the parts are joined: a sort or aggregation takes at least one page of a
    task's memory, and one stage would run those of all parts, which are all partitioned by series.
    """
    frequencies = written(frequencies.select(KEY, "frequency"), "frequencies")
    whole = written(panel.groupBy(KEY).agg(*_basic_columns(), *_moment_columns(), *_line_columns(), F.max("i").alias("last_i")), "sums")
    line = _tested_line(whole.select(KEY, "points", "slope", "intercept", "r"))
    lags = from_sums(lag_pass(panel, stats=whole.select(KEY, "mean", F.col("dataset_size").alias("n"), "last_i")))
    joined = whole.drop("points", "slope", "intercept", "r", "last_i").join(frequencies, KEY, "left")
    for name, part in (
        ("quartiles", quantile_features(panel)),
        ("trend", trend_flags(line)),
        ("strength", trend_strength(panel, line)),
        ("season", seasonality_features(panel, frequencies)),
        ("unit_root", adf(panel, adf_max_lag).select(KEY, "adf_statistic", "adf_p_value", "is_stationary")),
        ("lags", lag_features(lags, CHANGES)),
    ):
        joined = joined.join(written(part, name), KEY, "left")
    return complexity(joined)
