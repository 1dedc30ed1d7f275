"""The recursion of additive smoothing, and what it makes of a state over a block of rows.

The state of one set of rates is a level, a slope and a season of m offsets. A step is affine in the state,
x' = A x + B y, and A depends on the rates and the phase only. So a block of rows turns any state x into
A^n x + b, where b is where the block's data leads from a zero state. Carrier applies A^n without running through n
rows: the response to level and slope is run once per set of rates, and the responses to the m
offsets are one response, shifted, so their sum is a convolution.
"""

from __future__ import annotations

import numpy as np


def first_state(y: np.ndarray, m: int):
    """Level before the first row, slope and seasonal offsets of the first rows (2 m, without a season 10)."""
    if m > 1:
        return season_state(y[:m], float(y[:m].mean()), float(y[m : 2 * m].mean()))
    head = y[: min(10, y.size)]
    slope, level = np.polyfit(np.arange(1, head.size + 1), head, 1) if head.size > 1 else (0.0, head[0])
    return level, slope, np.zeros(1)


def season_state(head: np.ndarray, mean: float, following: float):
    """The same from the first season, its mean and that of the second."""
    m = len(head)
    slope = (following - mean) / m
    level = mean - slope * (m + 1) / 2
    return level, slope, head - (level + slope * np.arange(1, m + 1))


class Smoother:
    """The recursion for all rates at once; season rows are phases, counted from position 0 of the series."""

    def __init__(self, m: int, rates: np.ndarray):
        self.m, self.rates = m, rates
        self.level = self.slope = np.zeros(len(rates))
        self.season, self.sse = np.zeros((m, len(rates))), np.zeros(len(rates))

    def begin(self, y: np.ndarray, i: int) -> Smoother:
        """Start from the first rows of a series; i is the position of the first."""
        level, slope, offsets = first_state(y, self.m)
        self.level, self.slope = np.full(len(self.rates), level), np.full(len(self.rates), slope)
        self.season[(i + np.arange(self.m)) % self.m] = offsets[:, None]
        return self

    def place(self, states: np.ndarray) -> Smoother:
        """Start from states [level, slope, season by phase], one row for each set of rates."""
        self.level, self.slope, self.season = states[:, 0].copy(), states[:, 1].copy(), states[:, 2:].T.copy()
        return self

    def states(self) -> np.ndarray:
        return np.column_stack([self.level, self.slope, self.season.T])

    def run(self, y: np.ndarray, i: int, watch=None) -> np.ndarray | None:
        """Move on by y, whose first row is at position i; with one set of rates, return the one-step fits."""
        m, rates = self.m, self.rates
        alpha, trend_rate, gamma = rates[:, 0], rates[:, 0] * rates[:, 1], rates[:, 2]
        if m > 1:
            # a seasonal rate above 1 - alpha would not be stable
            gamma = np.minimum(gamma, 0.9 * (1 - alpha))
        level, slope, sse = self.level, self.slope, self.sse
        fits = np.empty(y.size) if len(rates) == 1 else None
        # a grid point that diverges on this series loses by its squared error
        with np.errstate(over="ignore", invalid="ignore"):
            for t in range(y.size):
                row = self.season[(i + t) % m]
                ahead = level + slope
                if fits is not None:
                    fits[t] = ahead[0] + row[0]
                error = y[t] - ahead - row
                level = ahead + alpha * error
                slope = slope + trend_rate * error
                if m > 1:
                    row += gamma * error
                sse += error * error
                if watch:
                    watch(t + 1, level, slope, self.season)
        self.level, self.slope = level, slope
        return fits


class Carrier:
    """States after n rows that are all zero: the linear part of a block of n rows."""

    _made: dict = {}

    @classmethod
    def of(cls, m: int, n: int, rates: np.ndarray) -> Carrier:
        """One per process and kind of block; the few last ones are kept."""
        key = m, n, rates.tobytes()
        if key not in cls._made:
            if len(cls._made) >= 4:
                cls._made.pop(next(iter(cls._made)))
            cls._made[key] = cls(m, n, rates)
        return cls._made[key]

    def __init__(self, m: int, n: int, rates: np.ndarray):
        self.m, self.n, g = m, n, len(rates)
        # unit level, unit slope, unit offset of the first row's phase
        units = np.zeros((3 * g, m + 2))
        for k in range(3):
            units[k * g : (k + 1) * g, k] = 1
        whole = n // m
        self.direct = np.zeros((2, g, m + 2))
        self.level_by, self.slope_by = np.zeros((m, g)), np.zeros((m, g))
        after = {0: units[2 * g :, 2:].T.copy()}

        def watch(t, level, slope, season):
            if t == n:
                ends = np.column_stack([level, slope, season.T])
                self.direct[:] = ends[:g], ends[g : 2 * g]
            if n - m < t <= n:
                # an offset k rows on has n - k rows to act
                self.level_by[n - t], self.slope_by[n - t] = level[2 * g :], slope[2 * g :]
            if t in (m * (whole - 1), m * whole, m * (whole + 1)):
                after[t // m] = season[:, 2 * g :].copy()

        Smoother(m, np.tile(rates, (3, 1))).place(units).run(np.zeros(max(n, m * (whole + 1))), 0, watch)
        if m == 1:
            # without a season its one offset stays as it is
            after = {c: np.ones((1, g)) for c in (whole - 1, whole, whole + 1)}
        none = np.zeros((m, g))
        # by how often a phase is met in the block: once less in phases before the offset's own
        self.responses = [np.fft.rfft(after.get(c, none), 2 * m, axis=0) for c in (whole - 1, whole, whole + 1)]

    def carry(self, states: np.ndarray, i: int, only: slice = slice(None)) -> np.ndarray:
        """States [level, slope, season by phase] after n zero rows, the first of them at position i, for some of the rates."""
        m, first = self.m, i % self.m
        level, slope, season = states[:, 0], states[:, 1], np.roll(states[:, 2:].T, -first, axis=0)
        out = level[:, None] * self.direct[0, only] + slope[:, None] * self.direct[1, only]
        out[:, 0] += (self.level_by[:, only] * season).sum(axis=0)
        out[:, 1] += (self.slope_by[:, only] * season).sum(axis=0)
        spectrum = np.fft.rfft(season, 2 * m, axis=0)
        fewer, same, more = (np.fft.irfft(spectrum * r[:, only], 2 * m, axis=0) for r in self.responses)
        cut = self.n % m
        out[:, 2:] += np.concatenate([more[:cut] + same[m : m + cut], same[cut:m] + fewer[m + cut :]]).T
        out[:, 2:] = np.roll(out[:, 2:], first, axis=1)
        return out
