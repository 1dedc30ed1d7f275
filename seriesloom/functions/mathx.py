"""Small numeric helpers used inside tasks, always on one short row per series."""

from __future__ import annotations

import math

import numpy as np

# Response surface of the Dickey-Fuller p-value, constant and no trend (MacKinnon 1994).
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
TAU_SMALL_P = (2.1659, 1.4412, 3.8269e-2)
TAU_LARGE_P = (1.7339, 9.3202e-1, -1.2745e-1, -1.0368e-2)

# Level-stationarity test, upper tail points (Kwiatkowski et al. 1992).
KPSS_POINTS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def student_t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| > |t|) through the incomplete beta function, by the Lentz continued fraction."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(df) & (df > 0) & ~np.isnan(t)
    t2 = t[ok] ** 2
    a, b, x = df[ok] / 2.0, np.full(ok.sum(), 0.5), np.where(np.isinf(t2), 0.0, df[ok] / (df[ok] + t2))
    out[ok] = _inc_beta(a, b, x)
    return out


def _inc_beta(a, b, x):
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x))
    front = np.where((x <= 0) | (x >= 1), 0.0, front)
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (
            m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    tail = front * h / p
    tail = np.where(flip, 1 - tail, tail)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.clip(tail, 0, 1)))


def dickey_fuller_p(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    coefs = TAU_SMALL_P if tau <= TAU_STAR else TAU_LARGE_P
    z = sum(c * tau**k for k, c in enumerate(coefs))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def partial_autocorrelation(cov: np.ndarray, n: int, max_lag: int) -> np.ndarray:
    """Durbin-Levinson on autocovariances scaled by n-k; entry 0 is 1."""
    gamma = np.array([cov[k] / (n - k) for k in range(max_lag + 1)])
    out = np.full(max_lag + 1, np.nan)
    out[0] = 1.0
    if max_lag < 1 or gamma[0] <= 0:
        return out
    r = gamma / gamma[0]
    phi = np.zeros(0)
    for k in range(1, max_lag + 1):
        below = 1 - phi @ r[1:k]
        if below == 0:
            break
        last = (r[k] - phi @ r[1:k][::-1]) / below
        phi = np.append(phi - last * phi[::-1], last)
        out[k] = last
    return out


def solve_normal(xtx: np.ndarray, xty: np.ndarray, ridge: np.ndarray | float = 0.0) -> np.ndarray:
    """Least squares from its normal equations, columns scaled first."""
    size = np.sqrt(np.maximum(np.diag(xtx), 1e-300))
    scaled = xtx / np.outer(size, size)
    penalty = np.broadcast_to(ridge, size.shape) / size**2
    return np.linalg.lstsq(scaled + np.diag(penalty), xty / size, rcond=1e-12)[0] / size


def dtw(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dynamic-time-warping distance of paired rows of a and b (same number of rows)."""
    return np.sqrt(warped_cost(a, b))


def warped_cost(a: np.ndarray, low: np.ndarray, high: np.ndarray | None = None, most: np.ndarray | None = None) -> np.ndarray:
    """Least warped path cost of the rows of a to paired rows of boxes [low, high]; without ``high`` boxes are points.

    A step costs the squared gap between value and box, so the cost of a series to the boxes around runs of another
    series' values never exceeds the cost to that series itself: a path meets every box it crosses at least once for each
    value. Rows that can't end at ``most`` or below are abandoned and come out infinite. The table is filled by
    antidiagonals, of which two are held; of any two neighbouring ones every path meets at least one.
    """
    rows, n, m = a.shape[0], a.shape[1], low.shape[1]
    out = np.full(rows, np.inf)
    live = np.arange(rows)
    a, low = np.ascontiguousarray(a.T), np.ascontiguousarray(low.T)
    high = None if high is None else np.ascontiguousarray(high.T)
    # entry i of a diagonal d stands for values 0..i-1 against boxes 0..d-i-1
    older, old, now = (np.full((n + 1, rows), np.inf) for _ in range(3))
    older[0] = 0.0
    for d in range(2, n + m + 1):
        first, last = max(1, d - m), min(n, d - 1)
        x, at = a[first - 1 : last], slice(d - last - 1, d - first)
        y = low[at][::-1]
        gap = x - y
        if high is not None:
            np.maximum(np.negative(gap, out=gap), x - high[at][::-1], out=gap)
            np.maximum(gap, 0.0, out=gap)
        gap *= gap
        best = np.minimum(old[first - 1 : last], old[first : last + 1])
        np.minimum(best, older[first - 1 : last], out=best)
        np.add(best, gap, out=now[first : last + 1])
        now[first - 1] = np.inf
        now[last + 1 : last + 2] = np.inf
        older, old, now = old, now, older
        if most is not None and d % 8 == 0:
            lo, hi = max(0, first - 2), last + 1
            keep = np.minimum(older[lo:hi].min(axis=0), old[lo:hi].min(axis=0)) <= most
            if keep.sum() < 0.8 * len(keep):
                live, most = live[keep], most[keep]
                if not len(live):
                    return out
                a, low, older, old, now = (np.ascontiguousarray(v[:, keep]) for v in (a, low, older, old, now))
                high = None if high is None else np.ascontiguousarray(high[:, keep])
    out[live] = old[n] if most is None else np.where(old[n] <= most, old[n], np.inf)
    return out
