"""Additive-trend exponential smoothing, with or without an additive season.

All parameter combinations of the grid move forward together as one vector, and the best combination is
taken per series. A series of up to one block is smoothed in one go. A longer one is smoothed block by
block: every block runs from a zero state, the true states at the block starts follow by composing the blocks'
affine maps, and a second run from there gives the errors. The result is that of one run through
the whole series, whatever the block size and the length of the season.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.blocks import by_block, chain_blocks, sum_vectors
from seriesloom.functions.smoothing import Carrier, Smoother, first_state, season_state
from seriesloom.panel import KEY, attach, with_block
from seriesloom.session import block_rows

ALPHAS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
BETAS = (0.01, 0.05, 0.1, 0.3)
GAMMAS = (0.05, 0.1, 0.3, 0.5, 0.7)
SCHEMA = (
    f"{KEY} string, status string, error string, season int, alpha double, beta double, gamma double, "
    "level double, slope double, pattern array<double>, sse double"
)
NAMES = [part.strip().split(" ")[0] for part in SCHEMA.split(",")]
STARTS = f"{KEY} string, season int, rate int, blk long, state array<double>"
# rows that the first state is taken from where there is no season
FIRST_ROWS = 10


def grid(seasonal: bool) -> np.ndarray:
    return np.array(list(itertools.product(ALPHAS, BETAS, GAMMAS if seasonal else (0.0,))))


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    # object columns keep a missing array as None
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names})


def _chosen(key, m: int, rates: np.ndarray, sse: np.ndarray, states: np.ndarray) -> dict:
    best = int(np.argmin(np.where(np.isnan(sse), np.inf, sse)))
    alpha, beta, gamma = (float(v) for v in rates[best])
    level, slope, *pattern = states[best].tolist()
    return {
        KEY: key, "status": "success", "season": m, "alpha": alpha, "beta": beta, "gamma": gamma,
        "level": level, "slope": slope, "pattern": pattern, "sse": float(sse[best]),
    }


def _failed(key, m: int, error: str) -> dict:
    return {KEY: key, "status": "failed", "season": m, "error": error}


def _least(m: int) -> int:
    return 2 * m if m > 1 else 3


TOO_SHORT, MISSING = "fewer rows than two seasons", "series has missing values"


def fit(
    train: DataFrame, seasonal: bool = True, value: str = "y", rates: Sequence[Sequence[float]] | None = None, size: int | None = None
) -> DataFrame:
    """Best grid point and final state per series; positions i run from 0 without gaps.

    rates lists sets (alpha, beta, gamma) to choose from in place of the grid, size the rows of a block.
    """
    size = size or block_rows(train.sparkSession)
    rates = grid(seasonal) if rates is None else np.array(rates, float)
    rows = train.select(KEY, "i", F.col(value).alias("y"), F.col("season") if seasonal else F.lit(1).alias("season"), *_length(train))
    if "n" not in rows.columns:
        rows = attach(rows, rows.groupBy(KEY).agg(F.count("*").alias("n"), F.max("i").alias("last_i")))

    def whole(pdf: pd.DataFrame) -> dict:
        key, m, y = pdf[KEY].iloc[0], int(pdf["season"].iloc[0]), pdf["y"].to_numpy(float)
        if y.size < _least(m):
            return _failed(key, m, TOO_SHORT)
        if not np.isfinite(y).all():
            return _failed(key, m, MISSING)
        i = int(pdf["i"].iloc[0])
        smoother = Smoother(m, rates).begin(y, i)
        smoother.run(y, i)
        return _chosen(key, m, rates, smoother.sse, smoother.states())

    few = rows.where(F.col("n") <= size).withColumn("w", F.lit(0))
    short = by_block(few, lambda frames: _frame([whole(pdf) for pdf in frames], NAMES), SCHEMA)
    return short.unionByName(_fit_long(rows.where(F.col("n") > size), size, rates))


def _length(rows: DataFrame) -> list:
    return [F.col("n_train").alias("n")] if "n_train" in rows.columns else []


def _fit_long(rows: DataFrame, size: int, rates: np.ndarray) -> DataFrame:
    usable = rows.where(F.col("n") >= F.when(F.col("season") > 1, 2 * F.col("season")).otherwise(3))
    starts = block_starts(usable, size, rates)

    def errors(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [KEY, "season", "sse", "ends"]
        if left.empty:
            return _frame([], names)
        left = left.sort_values("i", ignore_index=True)
        y, i, m = left["y"].to_numpy(float), int(left["i"].iloc[0]), int(left["season"].iloc[0])
        smoother = Smoother(m, rates).place(_states(right, len(rates)))
        smoother.run(y, i)
        last = i + y.size == int(left["n"].iloc[0])
        # the sum of errors says whether a value was missing
        out = {KEY: left[KEY].iloc[0], "season": m, "sse": smoother.sse.tolist(), "ends": smoother.states().ravel().tolist() if last else None}
        return _frame([out], names)

    blocks = with_block(usable, size)
    schema = f"{KEY} string, season int, sse array<double>, ends array<double>"
    run = blocks.groupBy(KEY, "blk").cogroup(starts.groupBy(KEY, "blk")).applyInPandas(errors, schema)
    summed = run.groupBy(KEY, "season").agg(sum_vectors("sse").alias("sse"), F.max_by("ends", F.col("ends").isNotNull()).alias("ends"))
    known = usable.groupBy(KEY).agg(F.count_if(F.col("y").isNull() | F.isnan("y") | (F.abs("y") == float("inf"))).alias("missing"))

    def finish(batches):
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                if r["missing"]:
                    out.append(_failed(r[KEY], r["season"], MISSING))
                else:
                    out.append(_chosen(r[KEY], r["season"], rates, np.asarray(r["sse"]), np.asarray(r["ends"]).reshape(len(rates), -1)))
            yield _frame(out, NAMES)

    done = summed.join(known, KEY).mapInPandas(finish, SCHEMA)
    least = F.when(F.col("season") > 1, 2 * F.col("season")).otherwise(3)
    few = rows.where(F.col("n") < least).groupBy(KEY).agg(F.first("season").cast("int").alias("season"))
    types = [part.strip().split(" ") for part in SCHEMA.split(",")]
    given = {"status": F.lit("failed"), "error": F.lit(TOO_SHORT), KEY: F.col(KEY), "season": F.col("season")}
    return done.unionByName(few.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in types]))


def _states(right: pd.DataFrame, count: int) -> np.ndarray:
    """States of a block's start by rate; the state of a series' start holds for all rates."""
    states = np.array(right.sort_values("rate")["state"].tolist(), float)
    return np.repeat(states, count, axis=0) if len(states) < count else states


def block_starts(rows: DataFrame, size: int, rates: np.ndarray | None = None) -> DataFrame:
    """KEY, season, rate, blk, state: the exact state at the start of every block of series of several blocks.

    rows have KEY, i, y, season and n, and, where no rates are given, one set of rates per series in alpha, beta, gamma.
    A series' first state is one row for all rates.
    """
    count = 1 if rates is None else len(rates)

    def from_zero(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        m, i = int(pdf["season"].iloc[0]), int(pdf["i"].iloc[0])
        used = pdf[["alpha", "beta", "gamma"]].to_numpy(float)[:1] if rates is None else rates
        smoother = Smoother(m, used)
        smoother.run(pdf["y"].to_numpy(float), i)
        out = {KEY: pdf[KEY].iloc[0], "season": m, "rate": np.arange(count), "blk": i // size, "state": list(smoother.states())}
        return pd.DataFrame({**out, "own": [used[0].tolist() if rates is None else None] * count})

    inner = with_block(rows, size).where((F.col("blk") + 1) * size < F.col("n"))
    offsets = inner.groupBy(KEY, "blk").applyInPandas(from_zero, f"{STARTS}, own array<double>")

    wanted = F.when(F.col("season") > 1, 2 * F.col("season")).otherwise(FIRST_ROWS)
    seasonal = F.col("season") > 1
    head = F.when(F.col("i") < F.when(seasonal, F.col("season")).otherwise(FIRST_ROWS), F.struct("i", "y"))
    firsts = rows.where(F.col("i") < wanted).groupBy(KEY, "season").agg(
        F.avg(F.when(F.col("i") < F.col("season"), F.col("y"))).alias("mean"),
        F.avg(F.when(F.col("i") >= F.col("season"), F.col("y"))).alias("following"),
        # a season of values, as long as the state itself
        F.transform(F.array_sort(F.collect_list(head)), lambda x: x["y"]).alias("head"),
    )

    def begin(batches):
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                head, m = np.array([np.nan if v is None else v for v in r["head"]], float), int(r["season"])
                if not np.isfinite(head).all():
                    level, slope, offsets = 0.0, 0.0, np.zeros(m)
                elif m > 1:
                    level, slope, offsets = season_state(head, r["mean"], np.nan_to_num(r["following"] or 0.0))
                else:
                    level, slope, offsets = first_state(head, m)
                out.append({KEY: r[KEY], "season": m, "rate": 0, "blk": 0, "state": [float(level), float(slope), *offsets.tolist()]})
            yield _frame(out, [KEY, "season", "rate", "blk", "state"])

    first = firsts.mapInPandas(begin, STARTS)
    spread = first.withColumn("rate", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    spread = spread.withColumns({"blk": F.lit(-1).cast("long"), "own": F.lit(None).cast("array<double>")})

    def compose(state, row):
        if row.blk < 0:
            return np.asarray(row.state, float)[None], None
        if rates is None:
            carrier, only = Carrier.of(int(row.season), size, np.asarray(row.own, float)[None]), slice(None)
        else:
            carrier, only = Carrier.of(int(row.season), size, rates), slice(row.rate, row.rate + 1)
        with np.errstate(over="ignore", invalid="ignore"):
            state = carrier.carry(state, int(row.blk) * size, only) + np.asarray(row.state, float)
        return state, {KEY: row.series_id, "season": row.season, "rate": row.rate, "blk": row.blk + 1, "state": state[0].tolist()}

    return first.unionByName(chain_blocks(offsets.unionByName(spread), [KEY, "rate"], compose, STARTS))


def predict(params: DataFrame, future: DataFrame) -> DataFrame:
    rows = attach(future.select(KEY, "ts", "i", "h"), params.where("status = 'success'"))
    phase = (F.col("i") % F.col("season")).cast("int")
    yhat = F.col("level") + F.col("h") * F.col("slope") + F.get("pattern", phase)
    return rows.select(KEY, "ts", "i", "h", yhat.alias("yhat"))
