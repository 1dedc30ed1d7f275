"""Additive regression forecaster: piecewise-linear trend plus yearly and weekly Fourier terms.

The design follows the published additive model of Taylor and Letham (2018); the prior scales
become ridge penalties, so a fit needs only the cross products of the design per series.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.blocks import block_vectors, rows_to_pandas
from seriesloom.functions.mathx import solve_normal
from seriesloom.operators.quality import epoch_seconds
from seriesloom.panel import KEY, attach

CHANGEPOINTS, CHANGEPOINT_RANGE = 25, 0.8
TERMS = [(365.25, 10), (7.0, 3)]
CHANGEPOINT_SCALE, SEASON_SCALE, NOISE = 0.05, 10.0, 0.05
SCHEMA = f"{KEY} string, status string, error string, t_lo double, t_hi double, size double, beta array<double>"

KNOTS = [CHANGEPOINT_RANGE * (k + 1) / CHANGEPOINTS for k in range(CHANGEPOINTS)]


def _design(t: np.ndarray, days: np.ndarray) -> np.ndarray:
    cols = [np.ones_like(t), t] + [np.maximum(t - k, 0.0) for k in KNOTS]
    for period, order in TERMS:
        for k in range(1, order + 1):
            cols += [np.sin(2 * np.pi * k * days / period), np.cos(2 * np.pi * k * days / period)]
    return np.column_stack(cols)


def _prediction(beta: str, t: Column, days: Column) -> Column:
    """The same design as column expressions, so prediction stays in the JVM."""
    b = lambda j: F.get(F.col(beta), F.lit(j))
    total, j = b(0) + b(1) * t, 2
    for knot in KNOTS:
        total, j = total + b(j) * F.greatest(t - knot, F.lit(0.0)), j + 1
    for period, order in TERMS:
        for k in range(1, order + 1):
            angle = days * (2 * np.pi * k / period)
            total, j = total + b(j) * F.sin(angle) + b(j + 1) * F.cos(angle), j + 2
    return total


def fit(train: DataFrame) -> DataFrame:
    days = epoch_seconds(F.col("ts")) / 86_400
    spans = train.groupBy(KEY).agg(
        F.min(days).alias("t_lo"), F.max(days).alias("t_hi"), F.max(F.abs("y")).alias("size"), F.count("y").alias("known"),
        F.max("i").alias("last_i"),
    )
    rows = attach(train.select(KEY, "i", "y", days.alias("days")), spans).where("y is not null")

    def kernel(pdf, own):
        pdf = pdf[own]
        lo, hi, size = (pdf[c].iloc[0] for c in ("t_lo", "t_hi", "size"))
        t = (pdf["days"].to_numpy() - lo) / max(hi - lo, 1e-9)
        x = np.column_stack([pdf["y"].to_numpy() / (size or 1.0), _design(t, pdf["days"].to_numpy())])
        return (x.T @ x).ravel()

    n_season = sum(2 * order for _, order in TERMS)
    ridge = NOISE**2 * np.concatenate(
        [np.full(2, 1 / 25.0), np.full(CHANGEPOINTS, 1 / CHANGEPOINT_SCALE**2), np.full(n_season, 1 / SEASON_SCALE**2)]
    )

    def finish(row):
        out = {KEY: row[KEY], "t_lo": row["t_lo"], "t_hi": row["t_hi"], "size": row["size"]}
        if row["known"] < 2:
            return {**out, "status": "failed", "error": "fewer than two observations"}
        d = 1 + 2 + CHANGEPOINTS + n_season
        g = np.asarray(row["vec"], float).reshape(d, d)
        beta = solve_normal(g[1:, 1:], g[1:, 0], ridge)
        return {**out, "status": "success", "error": None, "beta": beta.tolist()}

    return rows_to_pandas(block_vectors(rows, kernel, back=0, keep=["t_lo", "t_hi", "size", "known"]), finish, SCHEMA)


def predict(params: DataFrame, future: DataFrame) -> DataFrame:
    rows = attach(future.select(KEY, "ts", "i", "h"), params.where("status = 'success'"))
    days = epoch_seconds(F.col("ts")) / 86_400
    t = (days - F.col("t_lo")) / F.greatest(F.col("t_hi") - F.col("t_lo"), F.lit(1e-9))
    scale = F.when(F.col("size") > 0, F.col("size")).otherwise(1.0)
    return rows.select(KEY, "ts", "i", "h", (_prediction("beta", t, days) * scale).alias("yhat"))
