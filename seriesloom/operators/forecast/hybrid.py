"""Two hybrids: seasonal adjustment plus smoothing, and averaged models with boosted residuals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.blocks import by_block, chain_blocks
from seriesloom.functions.smoothing import Smoother
from seriesloom.operators.decompose import decompose
from seriesloom.operators.forecast import arima, boosted, ets, naive
from seriesloom.panel import KEY, attach, in_halo, own_rows, with_halo
from seriesloom.session import block_rows, written

RESIDUAL_LAGS = (1, 2, 3)
RESIDUAL_DEPTH = 3


def fit_seasonal_ets(train: DataFrame, candidates: Sequence[int] | None = None) -> DataFrame:
    """Deseasonalise by decomposition, smooth the rest, keep the seasonal pattern of the last season.

    ``candidates`` lists the season lengths in use where they are known; otherwise they are looked up.
    """
    sizes = train.select(KEY, "i", "n_train", "season")
    parts = decompose(train, "season", candidates)
    adjusted = parts.join(sizes.hint("merge"), [KEY, "i"]).withColumn("adjusted", F.col("y") - F.col("seasonal"))
    smooth = ets.fit(adjusted.where("seasonal is not null"), seasonal=False, value="adjusted")
    pattern = naive.last_season(adjusted.where("seasonal is not null"), value="seasonal")
    every = train.groupBy(KEY).agg(F.max("season").alias("season"))
    return (
        every.join(smooth.drop("season", "pattern"), KEY, "left")
        .join(pattern.drop("season"), KEY, "left")
        .withColumn("error", F.when(F.col("status").isNull(), "fewer rows than two seasons").otherwise(F.col("error")))
        .withColumn("status", F.coalesce("status", F.lit("failed")))
    )


def base_fits(train: DataFrame, arima_params: DataFrame, ets_params: DataFrame) -> DataFrame:
    """Training rows with the mean of both one-step fits and its residual.

    Both recursions go through a long series block by block, from the exact states at the block starts.
    """
    size = block_rows(train.sparkSession)
    known = arima_params.where("status = 'success'").select(KEY, "phi", "theta").join(
        ets_params.where("status = 'success'").select(KEY, "alpha", "beta", "gamma"), KEY
    )
    rows = attach(train.select(KEY, "i", "y", "season", F.col("n_train").alias("n")), known)
    schema = f"{KEY} string, i long, y double, base double"

    def fits(pdf, smoother, i, before):
        y = pdf["y"].to_numpy(float)
        one, _ = arima.fitted_steps(y, pdf["phi"].iloc[0], pdf["theta"].iloc[0], before)
        return pdf[[KEY, "i", "y"]].assign(base=0.5 * (smoother.run(y, i) + one))

    def rates(pdf):
        return pdf[["alpha", "beta", "gamma"]].to_numpy(float)[:1]

    def whole(pdf):
        m, i = int(pdf["season"].iloc[0]), int(pdf["i"].iloc[0])
        return fits(pdf, Smoother(m, rates(pdf)).begin(pdf["y"].to_numpy(float), i), i, None)

    def several(frames):
        made = [whole(pdf) for pdf in frames if len(pdf) >= 2 * int(pdf["season"].iloc[0])]
        return pd.concat(made, ignore_index=True) if made else pd.DataFrame({KEY: [], "i": [], "y": [], "base": []})

    short = by_block(rows.where(F.col("n") <= size).withColumn("w", F.lit(0)), several, schema)

    long = rows.where((F.col("n") > size) & (F.col("n") >= 2 * F.col("season")))
    # a change needs the row before, and the first row of a block the change before
    reach = with_halo(long, back=2)

    def parts(pdf, blk):
        pdf = pdf.sort_values("i", ignore_index=True)
        own = (pdf["i"] // size == blk).to_numpy()
        y, rows = pdf["y"].to_numpy(float), pdf[own].reset_index(drop=True)
        first = int(np.argmax(own))
        return rows, (y[first - 1], y[first - 1] - y[first - 2] if first > 1 else 0.0) if first else None

    def from_zero(key, pdf):
        rows, before = parts(pdf, key[1])
        _, (_, _, e) = arima.fitted_steps(rows["y"].to_numpy(float), rows["phi"].iloc[0], rows["theta"].iloc[0], before and (*before, 0.0))
        return pd.DataFrame({KEY: [key[0]], "blk": [key[1]], "e": [e], "theta": [rows["theta"].iloc[0]]})

    ends = reach.groupBy(KEY, "w").applyInPandas(from_zero, f"{KEY} string, blk long, e double, theta double")

    def compose(e, row):
        e = row.e + (-row.theta) ** size * (e or 0.0)
        return e, {KEY: row.series_id, "blk": row.blk + 1, "e": e}

    errors = chain_blocks(ends, [KEY], compose, f"{KEY} string, blk long, e double")
    starts = ets.block_starts(long, size).join(errors, [KEY, "blk"], "left").withColumnRenamed("blk", "w")

    def block(left, right):
        if left.empty:
            return pd.DataFrame({KEY: [], "i": [], "y": [], "base": []})
        rows, before = parts(left, left["w"].iloc[0])
        smoother = Smoother(int(rows["season"].iloc[0]), rates(rows)).place(np.array(right["state"].tolist(), float))
        return fits(rows, smoother, int(rows["i"].iloc[0]), before and (*before, float(right["e"].iloc[0])))

    made = reach.groupBy(KEY, "w").cogroup(starts.groupBy(KEY, "w")).applyInPandas(block, schema)
    return short.unionByName(made).withColumn("resid", F.col("y") - F.col("base"))


def predict_boosted(
    parts: DataFrame, arima_params: DataFrame, ets_params: DataFrame, rounds: int = boosted.ROUNDS
) -> DataFrame:
    """Mean of ARIMA and smoothing plus trees on the last three residuals, newest first.

    Future residuals are unknown and enter as zeros, so only three steps differ from a constant.
    """
    train = parts.where("is_train")
    resid = written(base_fits(train, arima_params, ets_params), "residuals")
    names = [f"lag_{k}" for k in RESIDUAL_LAGS]
    top = max(RESIDUAL_LAGS)
    lagged = own_rows(
        with_halo(resid, back=top).select(
            "*", *[F.lag("resid", k).over(in_halo()).alias(f"lag_{k}") for k in RESIDUAL_LAGS]
        )
    ).dropna(subset=names)
    scale = resid.groupBy(KEY).agg(F.avg("resid").alias("centre"), F.stddev_pop("resid").alias("spread"))
    scale = scale.withColumn("spread", F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0))
    z = lambda c: (F.col(c) - F.col("centre")) / F.col("spread")
    rows = attach(lagged, scale).select(KEY, "i", z("resid").alias("z_resid"), *[z(c).alias(f"z_{c}") for c in names])
    inputs = [f"z_{c}" for c in names]
    assembler, model = boosted.train_trees(rows, inputs, "z_resid", rounds, RESIDUAL_DEPTH)

    sizes = train.select(KEY, "n_train").distinct()
    recent = (
        attach(resid, sizes)
        .where(F.col("i") >= F.col("n_train") - top)
        .groupBy(KEY)
        .agg(*[F.max(F.when(F.col("i") == F.col("n_train") - k, F.col("resid"))).alias(f"last_{k}") for k in RESIDUAL_LAGS])
    )
    future = parts.where("not is_train").withColumn("h", F.col("i") - F.col("n_train") + 1)
    one = arima.predict(arima_params, future).select(KEY, "h", F.col("yhat").alias("one"))
    two = ets.predict(ets_params, future)
    h = F.col("h")

    def lag(k):
        # h - k > 0 points at a future residual, otherwise at the last known ones
        chain = F
        for step in range(1, k + 1):
            chain = chain.when(h == step, F.col(f"last_{k - step + 1}"))
        return chain.otherwise(F.lit(0.0))

    ahead = attach(two.join(one.hint("merge"), [KEY, "h"]), recent.join(scale, KEY))
    ahead = ahead.select("*", *[lag(k).alias(f"lag_{k}") for k in RESIDUAL_LAGS])
    ahead = ahead.select("*", *[z(c).alias(f"z_{c}") for c in names]).dropna(subset=inputs)
    scored = model.transform(assembler.transform(ahead))
    yhat = 0.5 * (F.col("one") + F.col("yhat")) + F.col("z_hat") * F.col("spread") + F.col("centre")
    return scored.select(KEY, "ts", "i", "h", yhat.alias("yhat"))
