"""ARIMA(1,1,1) and SARIMA(1,1,1)(1,1,1,s) by the Hannan-Rissanen regression.

A long autoregression gives the innovations, a second regression the coefficients. Both are
functions of the same cross products of lagged differences, so the data is read once; all
that is left per series is a small matrix and the last few values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.blocks import block_vectors, rows_to_pandas
from seriesloom.functions.mathx import solve_normal
from seriesloom.panel import KEY, attach
from seriesloom.session import block_rows

LIMIT = 0.95
MIN_ROWS = 8
SEGMENT = 4_096
# the seasonal coefficients are settled if a round moves none of them by more
SETTLED, ROUNDS = 1e-10, 1_000
SCHEMA = (
    f"{KEY} string, status string, error string, season int, phi double, theta double, "
    "seasonal_phi double, seasonal_theta double, long_lags array<int>, y_tail array<double>, w_tail array<double>, e_tail array<double>"
)


def _plan(n: int, s: int):
    """Lags of the long autoregression, of the model, and all lags the products need."""
    if s:
        spare, model = n - s - 1, [1, s, s + 1]
        options = [[1, 2, 3, s, s + 1, 2 * s], [1, 2, s], [1, s], [1]]
    else:
        spare, model = n - 1, [1]
        options = [list(range(1, m + 1)) for m in (10, 5, 2, 1)]
    long = options[-1]
    for option in options:
        if spare - model[-1] - max(option) >= 5 * len(option) + MIN_ROWS:
            long = sorted(set(option))
            break
    need = sorted({0, *model, *long, *(a + b for a in model for b in long)})
    return long, model, need, spare - need[-1]


def _differenced(y: np.ndarray, s: int) -> np.ndarray:
    w = np.diff(y)
    return w[s:] - w[:-s] if s else w


def _span(n: int, s: int) -> int:
    """Rows before a position that the products of a model reach."""
    return _plan(n, s)[2][-1] + s + 1


def _offsets(need: list[int], s: int) -> np.ndarray:
    """Distances between a position and the values that its lagged differences are made of."""
    parts = (0, 1, s, s + 1) if s else (0, 1)
    return np.unique([a + b for a in need for b in parts])


def _ranges(n: int, s: int, size: int) -> list[tuple[int, int]]:
    """The distances as ranges; those of a long season are a few short ones, far apart."""
    found: list[list[int]] = []
    for x in _offsets(_plan(n, s)[2], s).tolist():
        # a gap of less than a block is cheaper to copy along
        if found and x - found[-1][1] <= size:
            found[-1][1] = x
        else:
            found.append([x, x])
    return [(a, b) for a, b in found]


def lag_sums(train: DataFrame, seasonal: bool) -> DataFrame:
    """Per series, vec: cross products of the lagged differences, and tail: the last values.

    A lag may be longer than a block: a block gets copies of the rows at those distances that its own need.
    """
    rows = train.select(KEY, "i", "y", "n_train", F.col("season") if seasonal else F.lit(0).alias("season"))
    size = block_rows(train.sparkSession)

    def kernel(pdf, own):
        n, s = int(pdf["n_train"].iloc[0]), int(pdf["season"].iloc[0])
        _, _, need, _ = _plan(n, s)
        y, at, d = pdf["y"].to_numpy(float), pdf["i"].to_numpy(), len(need)
        here = at[own]
        here = here[here >= _span(n, s)]
        if not here.size:
            return np.zeros(d * d)
        value = {int(k): y[np.searchsorted(at, here - k)] for k in _offsets(need, s)}
        x = np.column_stack([
            value[k] - value[k + 1] - (value[k + s] - value[k + s + 1]) if s else value[k] - value[k + 1] for k in need
        ])
        return (x.T @ x).ravel()

    shapes = rows.groupBy(KEY).agg(F.first("n_train").alias("n"), F.first("season").alias("s"))

    def plans(batches):
        for batch in batches:
            ranges = [_ranges(int(n), int(s), size) for n, s in zip(batch["n"], batch["s"])]
            spans = [_span(int(n), int(s)) for n, s in zip(batch["n"], batch["s"])]
            found = [[{"lo": a, "hi": b} for a, b in r] for r in ranges]
            yield pd.DataFrame({KEY: batch[KEY], "ranges": found, "span": spans, "last_i": batch["n"] - 1})

    planned = shapes.mapInPandas(plans, f"{KEY} string, ranges array<struct<lo:long,hi:long>>, span long, last_i long")
    reaching = attach(rows, planned)
    sums = block_vectors(reaching.drop("span"), kernel, back=F.col("ranges"), keep=["n_train", "season"])
    # as long as the state of the model, about four seasons
    tails = reaching.where(F.col("i") >= F.col("n_train") - F.col("span") - 1).groupBy(KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda x: x["y"]).alias("tail")
    )
    return sums.join(tails, KEY)


def _clip(v: float) -> float:
    return float(np.clip(v, -LIMIT, LIMIT)) if np.isfinite(v) else 0.0


def _coefficients(g: np.ndarray, s: int):
    """Minimise the squared error over phi, theta and, with a season, their seasonal partners."""
    a, b = g[1:, 1:], g[1:, 0]
    if not s:
        phi, theta = solve_normal(a, b)
        return _clip(phi), _clip(theta), 0.0, 0.0
    phi = theta = sphi = stheta = 0.0
    for _ in range(ROUNDS):
        before = (phi, theta, sphi, stheta)
        for name in ("phi", "sphi", "theta", "stheta"):
            # the coefficient vector is linear in each parameter while the others are held
            p = {"phi": phi, "sphi": sphi, "theta": theta, "stheta": stheta}
            at = lambda v: _expanded(**{**p, name: v})
            base = at(0.0)
            step = at(1.0) - base
            best = _clip(step @ (b - a @ base) / max(step @ a @ step, 1e-300))
            phi, sphi = (best, sphi) if name == "phi" else (phi, best if name == "sphi" else sphi)
            theta, stheta = (best, stheta) if name == "theta" else (theta, best if name == "stheta" else stheta)
        if max(abs(x - z) for x, z in zip(before, (phi, theta, sphi, stheta))) < SETTLED:
            break
    return phi, theta, sphi, stheta


def _expanded(phi, sphi, theta, stheta):
    return np.array([phi, sphi, -phi * sphi, theta, stheta, theta * stheta])


def fit(train: DataFrame, seasonal: bool = False) -> DataFrame:
    def finish(row):
        n, s = int(row["n_train"]), int(row["season"])
        long, model, need, usable = _plan(n, s)
        out = {KEY: row[KEY], "status": "failed", "season": s}
        if usable < MIN_ROWS or (seasonal and s < 2):
            return {**out, "error": "too few observations for the model"}
        d = len(need)
        gram, tail = np.asarray(row["vec"], float).reshape(d, d), np.asarray(row["tail"], float)
        if not (np.isfinite(gram).all() and np.isfinite(tail).all()):
            return {**out, "error": "series has missing values"}
        at = {k: j for j, k in enumerate(need)}
        own = [at[k] for k in long]
        ar = solve_normal(gram[np.ix_(own, own)], gram[own, 0], ridge=1e-9 * max(gram[0, 0], 1e-12))
        mix = np.zeros((1 + 2 * len(model), d))
        mix[0, 0] = 1
        for j, lag in enumerate(model):
            mix[1 + j, at[lag]] = 1
            mix[1 + len(model) + j, at[lag]] = 1
            for k, c in zip(long, ar):
                mix[1 + len(model) + j, at[lag + k]] -= c
        phi, theta, sphi, stheta = _coefficients(mix @ gram @ mix.T, s)
        w = _differenced(tail, s)
        keep, deep = s + 1, max(long)
        e = np.array([w[t] - sum(c * w[t - k] for k, c in zip(long, ar)) for t in range(w.size - keep, w.size)])
        return {
            **out,
            "status": "success",
            "error": None,
            "phi": phi,
            "theta": theta,
            "seasonal_phi": sphi,
            "seasonal_theta": stheta,
            # lags of the autoregression behind the innovations, fewer for short series
            "long_lags": long,
            "y_tail": tail[-keep:].tolist(),
            "w_tail": w[-keep:].tolist(),
            "e_tail": e.tolist(),
        }

    return rows_to_pandas(lag_sums(train, seasonal), finish, SCHEMA)


def predict(params: DataFrame, future: DataFrame) -> DataFrame:
    """Closed form without a season; with one, the recursion runs in segments of the horizon."""
    rows = future.select(KEY, "ts", "i", "h")
    good = params.where("status = 'success'")
    phi, h = F.col("phi"), F.col("h")
    last = lambda c: F.element_at(c, -1)
    first = phi * last("w_tail") + F.col("theta") * last("e_tail")
    closed = last("y_tail") + first * (1 - F.pow(phi, h)) / (1 - phi)
    plain = attach(rows, good.where("season = 0")).select(KEY, "ts", "i", "h", closed.alias("yhat"))

    ends = rows.groupBy(KEY).agg(F.max("h").alias("h_max"))
    pieces = (
        good.where("season > 0")
        .join(ends, KEY)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"(h_max - 1) div {SEGMENT}"))))
    )
    made = pieces.mapInPandas(_segments, f"{KEY} string, h long, yhat double")
    return plain.unionByName(rows.join(made.hint("merge"), [KEY, "h"]).select(KEY, "ts", "i", "h", "yhat"))


def _transition(r, k: int) -> np.ndarray:
    """One step of the state [w lags, e lags, y lags], newest first."""
    s, size = k - 1, 3 * k
    step = np.zeros((size, size))
    phi, theta, sphi, stheta = r.phi, r.theta, r.seasonal_phi, r.seasonal_theta
    for lag, a, b in ((1, phi, theta), (s, sphi, stheta), (s + 1, -phi * sphi, theta * stheta)):
        step[0, lag - 1] += a
        step[0, k + lag - 1] += b
    step[2 * k] = step[0]
    for lag, c in ((1, 1.0), (s, 1.0), (s + 1, -1.0)):
        step[2 * k, 2 * k + lag - 1] += c
    for start in (0, k, 2 * k):
        step[np.arange(start + 1, start + k), np.arange(start, start + k - 1)] = 1
    return step


def _segments(batches):
    for batch in batches:
        for r in batch.itertuples(index=False):
            k = r.season + 1
            step = _transition(r, k)
            state = np.concatenate([np.asarray(v, float)[::-1] for v in (r.w_tail, r.e_tail, r.y_tail)])
            begin = r.piece * SEGMENT
            if begin:
                state = np.linalg.matrix_power(step, int(begin)) @ state
            count = min(SEGMENT, r.h_max - begin)
            out = np.empty(count)
            for t in range(count):
                state = step @ state
                out[t] = state[2 * k]
            yield pd.DataFrame({KEY: r.series_id, "h": begin + 1 + np.arange(count), "yhat": out})


def fitted_kernel(y: np.ndarray, s: int, phi, theta, sphi, stheta) -> np.ndarray:
    """One-step fits; the first s+1 values take the value before them."""
    out = np.concatenate([y[:1], y[:-1]]) if y.size else y
    w = _differenced(y, s) if y.size > s + 1 else np.zeros(0)
    e = np.zeros(w.size)
    lags = [(1, phi, theta)] + ([(s, sphi, stheta), (s + 1, -phi * sphi, theta * stheta)] if s else [])
    for t in range(w.size):
        guess = sum(a * w[t - k] + b * e[t - k] for k, a, b in lags if t >= k)
        e[t] = w[t] - guess
    out[s + 1 :] = y[s + 1 :] - e
    return out


def fitted_steps(y: np.ndarray, phi: float, theta: float, before: tuple | None):
    """One-step fits without a season of the next rows, and what to pass on: last value, change and error."""
    out = np.empty(y.size)
    last, w, e = before or (y[0], 0.0, 0.0)
    for t in range(y.size):
        guess = 0.0 if before is None and t == 0 else phi * w + theta * e
        out[t] = last + guess
        # the first row has no change
        if before is not None or t:
            w, e = y[t] - last, y[t] - out[t]
        last = y[t]
    return out, (last, w, e)
