"""Autocorrelation, partial autocorrelation and the lags they recommend."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.mathx import partial_autocorrelation
from seriesloom.panel import KEY, attach, in_halo, own_rows, with_halo

MAX_LAG = 40


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _partial(cov: pd.Series, n: pd.Series, top: pd.Series) -> pd.Series:
    return pd.Series(
        [partial_autocorrelation(np.asarray(c, float), int(m), int(k)) for c, m, k in zip(cov, n, top)]
    )


def lag_pass(panel: DataFrame, max_lag: int = MAX_LAG, stats: DataFrame | None = None) -> DataFrame:
    """One row per series: n, cov (products of centred values at lags 0 to max_lag) and change features.

    Everything comes from one window pass and one aggregation. ``stats`` may bring mean, n and
    last_i of each series along; otherwise they are computed first.
    """
    if stats is None:
        stats = panel.groupBy(KEY).agg(F.avg("y").alias("mean"), F.count("y").alias("n"), F.max("i").alias("last_i"))
    centred = attach(panel.select(KEY, "i", "y"), stats.select(KEY, "mean", "n", "last_i")).withColumn("c", F.col("y") - F.col("mean"))
    lagged = with_halo(centred, back=max_lag).select(
        KEY, "n", "w", "i", "c", *[F.lag("c", k).over(in_halo()).alias(f"c{k}") for k in range(1, max_lag + 1)]
    )
    c, before = F.col("c"), F.col("c1")
    products = [F.sum(c * c)] + [F.sum(c * F.col(f"c{k}")) for k in range(1, max_lag + 1)]
    return own_rows(lagged).groupBy(KEY, "n").agg(
        F.array(*[F.coalesce(p, F.lit(0.0)) for p in products]).alias("cov"),
        F.avg(F.abs(c - before)).alias("mean_abs_change"),
        F.stddev_pop(c - before).alias("std_1st_diff"),
        (F.count_if(F.signum(c) != F.signum(before)) / F.count("*")).alias("zero_crossing_rate"),
    )


def correlogram(panel: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """One row per series: n, band and the arrays acf, pacf from lag 0 on. Expects a filled series."""
    return from_sums(lag_pass(panel, max_lag), max_lag)


def from_sums(sums: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    top = F.least(F.lit(max_lag), F.expr("n div 2"))
    partial_top = F.greatest(F.lit(0), F.least(F.lit(max_lag), F.expr("n div 2 - 1")))
    spread = F.get("cov", F.lit(0))
    return sums.select(
        "*",
        (1.96 / F.sqrt("n")).alias("band"),
        F.when(
            spread > 0, F.transform(F.slice("cov", F.lit(1), (top + 1).cast("int")), lambda v: v / spread)
        ).alias("acf"),
        F.when(spread > 0, _partial("cov", "n", partial_top)).alias("pacf"),
    )


def correlogram_frame(rows: DataFrame) -> DataFrame:
    """Long chart frame with the 95 % band."""
    long = rows.select(KEY, "band", "pacf", F.posexplode("acf").alias("lag", "acf"))
    return long.select(
        KEY, "lag", "acf", F.get("pacf", "lag").alias("pacf"), (-F.col("band")).alias("lower"), F.col("band").alias("upper")
    )


def significant_lags(values: str) -> F:
    """Lags from 1 on whose value leaves the band."""
    lags = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(values) - 1))
    return F.filter(lags, lambda k: F.abs(F.get(F.col(values), k)) > F.col("band"))


def lag_features(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    usable = F.size("acf") > 1
    found, partial = significant_lags("acf"), significant_lags("pacf")
    sizes = F.transform(F.slice("acf", 2, MAX_LAG * 1000), F.abs)
    return rows.select(
        KEY,
        *keep,
        F.when(usable, F.get("acf", F.lit(1))).otherwise(0.0).alias("lag_1_acf"),
        F.when(usable, F.coalesce(F.get(partial, F.lit(0)), F.lit(0))).otherwise(1).cast("int").alias("pacf_order"),
        F.when(usable & (F.size(found) > 0), F.slice(found, 1, 5)).otherwise(F.array(F.lit(1))).alias("recommended_lags"),
        F.when(usable, F.array_position(sizes, F.array_max(sizes))).otherwise(1).cast("int").alias("max_acf_lag"),
    )
