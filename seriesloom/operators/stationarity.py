"""Unit-root and level-stationarity tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.blocks import block_vectors, rows_to_pandas
from seriesloom.functions.mathx import KPSS_POINTS, dickey_fuller_p, solve_normal
from seriesloom.panel import KEY, attach, with_running_sum
from seriesloom.session import written

def _lag_order(n: int, max_lag: int | None) -> int:
    rule = int(np.ceil(12.0 * (n / 100.0) ** 0.25))
    top = n // 2 - 2
    return min(top, rule if max_lag is None else max_lag)


def _design(z: np.ndarray, lags: int) -> np.ndarray:
    """Rows [dz_t, 1, z_(t-1), dz_(t-1) .. dz_(t-lags)] for t = lags+1 .. end."""
    dz = np.diff(z)
    rows = dz.size - lags
    cols = [dz[lags:], np.ones(rows), z[lags:-1]]
    cols += [dz[lags - k : dz.size - k] for k in range(1, lags + 1)]
    return np.column_stack(cols)


def adf_sums(panel: DataFrame, max_lag: int | None = None) -> DataFrame:
    """Cross products of the test regression per series, then its first ``lags + 1`` values.

    The series is standardised first; the statistic does not change with scale or level.
    """
    stats = panel.groupBy(KEY).agg(
        F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"), F.count("y").alias("n"), F.max("i").alias("last_i")
    )
    z = F.try_divide(F.col("y") - F.col("mean"), F.col("sd"))
    rows = attach(panel, stats).where((F.col("n") >= 4) & (F.col("sd") > 0)).select(KEY, "i", "n", z.alias("z"))
    # each series looks back as far as its own lag order needs; one row to spare against rounding of the rule
    rule = F.ceil(12.0 * F.pow(F.col("n") / 100.0, F.lit(0.25))) if max_lag is None else F.lit(max_lag)
    ranges = F.array(F.struct(F.lit(0).cast("long").alias("lo"), (rule.cast("long") + 2).alias("hi")))

    def kernel(pdf, own):
        lags = _lag_order(int(pdf["n"].iloc[0]), max_lag)
        values, first = pdf["z"].to_numpy(), int(np.argmax(own))
        start = max(0, first - lags - 1)
        part = values[start:]
        d = lags + 3
        gram = np.zeros(d * d)
        if part.size > lags + 1:
            x = _design(part, lags)
            gram = (x.T @ x).ravel()
        opening = values[: lags + 1] if pdf["i"].iloc[0] == 0 and first == 0 else np.zeros(lags + 1)
        return np.concatenate([gram, opening, np.zeros(lags + 1 - opening.size)])

    return block_vectors(rows, kernel, back=ranges, keep=["n"])


def adf(panel: DataFrame, max_lag: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant; lag order by AIC up to the usual rule.

    ``max_lag=0`` gives the plain Dickey-Fuller test.
    """

    def finish(row):
        n, vec = int(row["n"]), np.asarray(row["vec"], float)
        top = _lag_order(n, max_lag)
        out = {KEY: row[KEY], "adf_statistic": None, "adf_p_value": None, "used_lag": None}
        if top < 0:
            return out
        d = top + 3
        gram, opening = vec[: d * d].reshape(d, d), vec[d * d :]
        nobs = n - 1 - top

        def residual(g, k):
            xtx, xty = g[1:k, 1:k], g[1:k, 0]
            beta = solve_normal(xtx, xty)
            return beta, max(g[0, 0] - beta @ xty, 1e-300)

        scores = [nobs * np.log(residual(gram, 3 + p)[1] / nobs) + 2 * (2 + p) for p in range(top + 1)]
        used = int(np.argmin(scores))
        # the final fit also uses the rows that only the longest lag order had to skip
        k = 3 + used
        final = gram[:k, :k].copy()
        if used < top:
            extra = _design(opening, used)
            final += extra.T @ extra
        beta, ssr = residual(final, k)
        dof = (n - 1 - used) - (2 + used)
        if dof <= 0:
            return out
        cov = np.linalg.pinv(final[1:k, 1:k]) * (ssr / dof)
        tau = float(beta[1] / np.sqrt(max(cov[1, 1], 1e-300)))
        return {**out, "adf_statistic": tau, "adf_p_value": dickey_fuller_p(tau), "used_lag": used}

    schema = f"{KEY} string, adf_statistic double, adf_p_value double, used_lag int"
    tested = rows_to_pandas(adf_sums(panel, max_lag), finish, schema)
    return (
        panel.select(KEY)
        .distinct()
        .join(tested, KEY, "left")
        .withColumn("is_stationary", F.coalesce(F.col("adf_p_value") < 0.05, F.lit(False)))
    )


def _lagged_totals(sums: DataFrame, lag) -> DataFrame:
    """Per series, over lags k = 1..lag of c_k = sum_t e_t e_(t-k): flat, the plain sum of c_k, and
    weighted, the sum of (1 - k/(lag+1)) c_k. The lag may be any number and differ per series.

    The weighted sum follows from squared rolling sums of length lag+1. Rolling sums are
    differences of the running sum, so two positions of a series meet in an equi-join.
    """
    cut = sums.withColumn("lag", lag.cast("long"))
    back = sums.select(KEY, F.col("i").alias("j"), F.col("s").alias("s_back"))
    met = cut.withColumn("j", F.col("i") - F.col("lag") - 1).join(back, [KEY, "j"], "left")
    e, s, old = F.col("e"), F.col("s"), F.coalesce("s_back", F.lit(0.0))
    # windows that reach past the end only lose rows: the total of all residuals is 0
    past = F.when(F.col("i") >= F.col("n") - F.col("lag") - 1, s * s).otherwise(0.0)
    totals = met.groupBy(KEY, "n", "lag").agg(
        F.sum((s - old) * (s - old) + past).alias("squares"),
        F.sum(e * e).alias("e2"),
        F.sum(e * (s - e - old)).alias("flat"),
        F.sum(s * s).alias("s2"),
        F.max("i").alias("last_i"),
    )
    return totals.withColumn("weighted", (F.col("squares") / (F.col("lag") + 1) - F.col("e2")) / 2)


def kpss(panel: DataFrame) -> DataFrame:
    """Level-stationarity test with the data-driven lag of Hobijn et al.; p from tabulated points."""
    stats = panel.groupBy(KEY).agg(F.avg("y").alias("mean"), F.count("y").alias("n"), F.max("i").alias("last_i"))
    rows = attach(panel.select(KEY, "i", "y"), stats).select(KEY, "i", "n", (F.col("y") - F.col("mean")).alias("e"))
    sums = written(with_running_sum(rows, "e", "s"), "running")
    n = F.col("n").cast("double")

    short = _lagged_totals(sums, F.floor(F.pow(n, F.lit(2.0 / 9.0)) + 1e-12))
    slope = 2 * (F.col("lag") + 1) * (F.col("flat") - F.col("weighted"))
    ratio = F.coalesce(F.try_divide(slope, F.col("e2") + 2 * F.col("flat")), F.lit(0.0))
    width = F.floor(1.1447 * F.cbrt(F.col("ratio") * F.col("ratio")) * F.cbrt(n))
    wide = _lagged_totals(attach(sums, short.select(KEY, "last_i", ratio.alias("ratio"))), F.least(width, F.col("n") - 1))
    variance = (F.col("e2") + 2 * F.col("weighted")) / n
    tested = wide.select(
        KEY, F.try_divide(F.col("s2") / (n * n), variance).alias("kpss_statistic"), F.col("lag").alias("kpss_lag")
    )
    return tested.withColumn("kpss_p_value", _interpolated_p(F.col("kpss_statistic")))


def _interpolated_p(stat):
    points = KPSS_POINTS
    chain = F.when(stat.isNull(), F.lit(None).cast("double")).when(stat <= points[0][0], F.lit(points[0][1]))
    for (x0, p0), (x1, p1) in zip(points, points[1:]):
        chain = chain.when(stat <= x1, p0 + (p1 - p0) * (stat - x0) / (x1 - x0))
    return chain.otherwise(F.lit(points[-1][1]))
