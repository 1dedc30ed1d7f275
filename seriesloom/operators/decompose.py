"""Classical additive decomposition and the frames built on it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.blocks import by_block
from seriesloom.panel import KEY, attach, with_reach, with_running_sum
from seriesloom.session import block_rows


def moving_means(rows: DataFrame, size: int, longest: int) -> DataFrame:
    """Add trend: the centred mean over one period, null near the ends and around missing values.

    rows have KEY, ts, i, y, n and period (0: none). A period of up to two blocks takes its sums from the rows around a
    block, a longer one from differences of the running sum, so each row is copied a few times however long the period is.
    ``longest`` is no less than the longest period.
    """
    half = F.floor(F.col("period") / 2).cast("long")
    schema = f"{KEY} string, ts timestamp_ntz, i long, y double, n long, period int, trend double"
    columns = [KEY, "ts", "i", "y", "n", "period"]

    def means(pdf: pd.DataFrame, own: np.ndarray, total, missing, value) -> pd.DataFrame:
        """total(d), missing(d), value(d): running sums up to and value at d positions from the block's own rows."""
        out = pdf.loc[own, columns]
        p, i, n = int(out["period"].iloc[0]), out["i"].to_numpy(), int(out["n"].iloc[0])
        trend, h = np.full(len(out), np.nan), p // 2
        fits = (i >= h) & (i + h < n) & (p > 0)
        if fits.any():
            i = i[fits]
            wide = total(i + h) - total(i - h - 1)
            whole = missing(i + h) == missing(i - h - 1)
            if p % 2 == 0:
                # an even period weighs both ends half
                wide = wide - 0.5 * (value(i + h) + value(i - h))
            trend[fits] = np.where(whole, wide / p, np.nan)
        return out.assign(trend=trend)

    def around(pdf):
        at, y = pdf["i"].to_numpy(), pdf["y"].to_numpy(float)
        own = at // size == pdf["w"].iloc[0]
        if not own.any():
            return pdf[columns].head(0).assign(trend=0.0)
        # sums of what lies above the mean lose less to rounding
        known = np.isfinite(y)
        centre = y[known].mean() if known.any() else 0.0
        sums = np.concatenate([[0.0], np.cumsum(np.where(known, y - centre, 0.0))])
        gaps = np.concatenate([[0], np.cumsum(~known)])
        place = lambda i: np.searchsorted(at, i, "right")
        out = means(pdf, own, lambda i: sums[place(i)], lambda i: gaps[place(i)], lambda i: y[place(i) - 1] - centre)
        out["trend"] += centre
        return out

    near = rows.where(F.col("period") <= 2 * size) if longest > 2 * size else rows
    served = with_reach(near, F.array(F.struct((-half).alias("lo"), (half + 1).alias("hi"))))
    made = by_block(served, lambda frames: pd.concat([around(v) for v in frames], ignore_index=True), schema)
    if longest <= 2 * size:
        return made

    def apart(key, pdf):
        pdf = pdf.sort_values("i", ignore_index=True)
        at, y, centre = pdf["i"].to_numpy(), pdf["y"].to_numpy(float), float(pdf["centre"].iloc[0])
        own = at // size == key[1]
        if not own.any():
            return pdf[columns].head(0).assign(trend=0.0)
        sums, gaps = pdf["sums"].to_numpy(float), pdf["gaps"].to_numpy(float)

        def before(values):
            # there is no row before the first
            return lambda i: np.where(i < 0, 0.0, values[np.minimum(np.searchsorted(at, np.maximum(i, 0)), len(at) - 1)])

        out = means(pdf, own, before(sums), before(gaps), before(y - centre))
        out["trend"] += centre
        return out

    far = rows.where(F.col("period") > 2 * size)
    centres = far.groupBy(KEY).agg(F.coalesce(F.avg("y"), F.lit(0.0)).alias("centre"), F.max("i").alias("last_i"))
    far = attach(far, centres).withColumn("above", F.coalesce(F.col("y") - F.col("centre"), F.lit(0.0)))
    far = with_running_sum(with_running_sum(far, "above", "sums").withColumn("gap", F.col("y").isNull().cast("int")), "gap", "gaps")
    ranges = F.array(*[F.struct(lo.alias("lo"), hi.alias("hi")) for lo, hi in ((-half, -half), (0 * half, 0 * half), (half, half + 1))])
    return made.unionByName(with_reach(far, ranges).groupBy(KEY, "w").applyInPandas(apart, schema))


def decompose(panel: DataFrame, period: int | str, candidates: Sequence[int] | None = None) -> DataFrame:
    """Add period, trend, seasonal, resid.

    ``period`` is one number, or the name of a column with a period per series; ``candidates`` may then list
    its values, which saves a look at the longest one. The trend ends are extended by a line through the
    nearest ``period`` trend points. Components are null for series with missing values or fewer than two periods.

    Both the lines at the ends and the seasonal means come from one aggregation: what the lines
    add to a seasonal mean depends only on sums of positions, so no second pass is needed.
    """
    size = block_rows(panel.sparkSession)
    if isinstance(period, int):
        longest, each = period, F.lit(period)
    else:
        each = F.greatest(F.coalesce(F.col(period).cast("int"), F.lit(0)), F.lit(0))
        longest = max(candidates) if candidates else panel.agg(F.max(each)).first()[0] or 0
    rows = panel.select(KEY, "ts", "i", "y", each.cast("int").alias("period"))
    sizes = rows.groupBy(KEY).agg(F.count("*").alias("n"), F.max("i").alias("last_i"))
    means = moving_means(attach(rows, sizes), size, longest)
    half = F.expr("period div 2")
    base = (
        means.withColumn("period", F.nullif("period", F.lit(0)))
        .withColumn("left", F.col("n") - 1 - F.col("i"))
        .withColumn("head", F.col("i") < half)
        .withColumn("tail", (F.col("left") < half) & ~F.col("head"))
        .withColumn("phase", F.col("i") % F.col("period"))
        .withColumn("x", F.when(F.col("head") | ~F.col("tail"), F.col("i") - half).otherwise(half - F.col("left")))
    )

    inner = ~F.col("head") & ~F.col("tail")
    first = inner & (F.col("i") < half + F.col("period")) & (F.col("left") > half)
    last = inner & (F.col("left") > half) & (F.col("left") <= half + F.col("period"))
    xf, xb, t = F.col("i") - half, half - F.col("left"), F.col("trend")

    def sums(prefix, hit, x):
        return [
            F.count_if(hit).alias(f"{prefix}_n"),
            F.sum(F.when(hit, x)).alias(f"{prefix}_x"),
            F.sum(F.when(hit, x * x)).alias(f"{prefix}_xx"),
            F.sum(F.when(hit, t)).alias(f"{prefix}_t"),
            F.sum(F.when(hit, x * t)).alias(f"{prefix}_xt"),
        ]

    by_phase = base.groupBy(KEY, "period", "phase").agg(
        F.count("*").alias("rows"),
        F.count("y").alias("known"),
        F.sum(F.when(inner, F.col("y") - t).otherwise(F.col("y"))).alias("rest"),
        F.count_if("head").alias("head_n"),
        F.coalesce(F.sum(F.when(F.col("head"), xf)), F.lit(0)).alias("head_x"),
        F.count_if("tail").alias("tail_n"),
        F.coalesce(F.sum(F.when(F.col("tail"), xb)), F.lit(0)).alias("tail_x"),
        *sums("f", first, xf),
        *sums("b", last, xb),
    )
    names = [f"{a}_{b}" for a in "fb" for b in ("n", "x", "xx", "t", "xt")]
    ends = by_phase.groupBy(KEY, "period").agg(
        F.sum("rows").alias("rows"),
        F.sum("known").alias("known"),
        *[F.sum(c).alias(c) for c in names],
        F.array_sort(
            F.collect_list(F.struct("phase", "rest", "rows", "head_n", "head_x", "tail_n", "tail_x"))
        ).alias("phases"),
    )

    def slope(a):
        top_, below = (
            F.col(f"{a}_n") * F.col(f"{a}_xt") - F.col(f"{a}_x") * F.col(f"{a}_t"),
            F.col(f"{a}_n") * F.col(f"{a}_xx") - F.col(f"{a}_x") * F.col(f"{a}_x"),
        )
        return F.coalesce(F.try_divide(top_, below), F.lit(0.0))

    lines = (
        ends.where((F.col("rows") >= 2 * F.col("period")) & (F.col("known") == F.col("rows")))
        .withColumn("f_k", slope("f"))
        .withColumn("b_k", slope("b"))
        .withColumn("f_c", F.try_divide(F.col("f_t") - F.col("f_k") * F.col("f_x"), F.col("f_n")))
        .withColumn("b_c", F.try_divide(F.col("b_t") - F.col("b_k") * F.col("b_x"), F.col("b_n")))
    )
    zero = F.lit(0.0)
    raw = F.transform(
        "phases",
        lambda s: (
            s["rest"]
            - F.coalesce(F.col("f_k") * s["head_x"] + F.col("f_c") * s["head_n"], zero)
            - F.coalesce(F.col("b_k") * s["tail_x"] + F.col("b_c") * s["tail_n"], zero)
        )
        / s["rows"],
    )
    lines = lines.withColumn("raw", raw)
    mean = F.aggregate("raw", zero, lambda a, v: a + v) / F.size("raw")
    lines = lines.withColumn("raw_mean", mean).select(
        KEY, (F.col("rows") - 1).alias("last_i"), "f_k", "f_c", "b_k", "b_c", F.transform("raw", lambda v: v - F.col("raw_mean")).alias("pattern")
    )
    full_trend = (
        F.when(F.col("pattern").isNull(), F.lit(None))
        .when(F.col("head"), F.col("f_c") + F.col("f_k") * F.col("x"))
        .when(F.col("tail"), F.col("b_c") + F.col("b_k") * F.col("x"))
        .otherwise(t)
    )
    return (
        attach(base, lines, "left")
        .withColumn("trend", full_trend)
        .withColumn("seasonal", F.get("pattern", F.col("phase").cast("int")))
        .withColumn("resid", F.col("y") - F.col("trend") - F.col("seasonal"))
        .select(KEY, "ts", "i", "y", "period", "trend", "seasonal", "resid")
    )


def component_variances(parts: DataFrame) -> DataFrame:
    return parts.groupBy(KEY).agg(
        F.var_samp("trend").alias("trend_var"),
        F.var_samp("seasonal").alias("seasonal_var"),
        F.var_samp("resid").alias("resid_var"),
    )


def strength(signal: Column, resid: Column) -> Column:
    """Share of a component against component plus residual, null without any variance."""
    return F.when(signal + resid > 0, F.greatest(F.lit(0.0), 1 - resid / (signal + resid)))


def decomposition_frame(panel: DataFrame, period: int | str) -> DataFrame:
    """Long chart frame: Observed, Trend, Seasonal, Residual; empty for series that are too short."""
    parts = decompose(panel, period).where(F.col("trend").isNotNull())
    named = parts.select(
        KEY,
        "ts",
        F.col("y").alias("Observed"),
        F.col("trend").alias("Trend"),
        F.col("seasonal").alias("Seasonal"),
        F.col("resid").alias("Residual"),
    )
    return named.unpivot([KEY, "ts"], ["Observed", "Trend", "Seasonal", "Residual"], "component", "value")


def before_after_frame(original: DataFrame, processed: DataFrame) -> DataFrame:
    """Rows before and after, side by side; of equal times, the first goes with the first and so on."""
    turn = F.row_number().over(Window.partitionBy(KEY, "ts").orderBy("i")).alias("turn")
    before = original.select(KEY, "ts", turn, F.col("y").alias("original"))
    return before.join(processed.select(KEY, "ts", turn, F.col("y").alias("processed")), [KEY, "ts", "turn"]).drop("turn")


def calendar_profile(panel: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Mean by weekday for hourly and daily series, by month for all others; absent slots stay null."""
    kinds = frequencies.select(KEY, F.col("frequency").isin("H", "D").alias("weekly"))
    slot = F.when(F.col("weekly"), F.weekday("ts")).otherwise(F.month("ts"))
    seen = (
        attach(panel, kinds).groupBy(KEY, slot.alias("slot")).agg(F.avg("y").alias("mean_y"))
    )
    slots = F.when(F.col("weekly"), F.sequence(F.lit(0), F.lit(6))).otherwise(F.sequence(F.lit(1), F.lit(12)))
    return (
        kinds.select(KEY, F.when(F.col("weekly"), "weekday").otherwise("month").alias("kind"), F.explode(slots).alias("slot"))
        .join(seen, [KEY, "slot"], "left")
        .select(KEY, "kind", "slot", "mean_y")
    )
