import numpy as np
import pandas as pd
import pytest

from seriesloom.functions import mathx
from seriesloom.operators import autocorr, decompose, profile, quality, stationarity
from tests.conftest import values_of


def parts_by_definition(y, p):
    """Classical additive decomposition with the ends of the trend extended by a line."""
    n, h = len(y), p // 2
    w = np.ones(p) / p if p % 2 else np.r_[0.5, np.ones(p - 1), 0.5] / p
    t = np.full(n, np.nan)
    t[h : n - h] = np.convolve(y, w, "valid")
    back = n - 1 - h
    lo, hi = np.arange(h, min(h + p, back)), np.arange(max(h, back - p), back)
    for fit, where in ((lo, np.arange(h)), (hi, np.arange(back + 1, n))):
        t[where] = np.polyval(np.polyfit(fit, t[fit], 1), where)
    s = np.array([np.mean((y - t)[k::p]) for k in range(p)])
    s = np.resize(s - s.mean(), n)
    return t, s, y - t - s


@pytest.mark.parametrize("size", [100, 65_536])
@pytest.mark.parametrize("p", [4, 7, 12, 24])
def test_decomposition(panel_of, blocks, waves, p, size):
    blocks(size)
    y = waves["wave"]
    out = decompose.decompose(panel_of({"a": y, "short": y[: 2 * p - 1], "edge": y[: 2 * p]}), p)
    for key, values in (("a", y), ("edge", y[: 2 * p])):
        for name, want in zip(("trend", "seasonal", "resid"), parts_by_definition(values, p)):
            np.testing.assert_allclose(values_of(out, name, key), want, atol=1e-8)
    assert set(values_of(out, "trend", "short")) == {None}
    assert abs(sum(values_of(out, "seasonal")[:p])) < 1e-9


def test_decomposition_needs_complete_series(panel_of, waves):
    y = list(waves["wave"])
    y[50] = None
    assert set(values_of(decompose.decompose(panel_of({"a": y}), 7), "resid")) == {None}


def adf_by_definition(y):
    n = len(y)
    top = min(n // 2 - 2, int(np.ceil(12 * (n / 100) ** 0.25)))
    dy = np.diff(y)

    def fit(lags, start):
        x = np.column_stack(
            [np.ones(len(dy) - start), y[start:-1]] + [dy[start - k : len(dy) - k] for k in range(1, lags + 1)]
        )
        d = dy[start:]
        beta, *_ = np.linalg.lstsq(x, d, rcond=None)
        ssr = np.sum((d - x @ beta) ** 2)
        return beta, ssr, x, len(d)

    aic = []
    for lags in range(top + 1):
        _, ssr, x, m = fit(lags, top)
        aic.append(m * np.log(ssr / m) + 2 * x.shape[1])
    used = int(np.argmin(aic))
    beta, ssr, x, m = fit(used, used)
    cov = np.linalg.inv(x.T @ x) * ssr / (m - x.shape[1])
    return beta[1] / np.sqrt(cov[1, 1]), used


@pytest.mark.parametrize("size", [64, 65_536])
def test_adf_against_direct_regressions(panel_of, blocks, waves, size):
    blocks(size)
    series = {**waves, "tiny": waves["walk"][:12], "flat": np.ones(50), "one": [1.0]}
    out = {r.series_id: r for r in stationarity.adf(panel_of(series)).collect()}
    for name in ("wave", "walk", "tiny"):
        tau, used = adf_by_definition(np.asarray(series[name]))
        assert out[name].used_lag == used
        assert out[name].adf_statistic == pytest.approx(tau, rel=1e-6)
    assert not out["walk"].is_stationary
    assert out["flat"].adf_statistic is None and not out["flat"].is_stationary
    assert out["one"].adf_p_value is None


def kpss_by_definition(y):
    e, n = y - y.mean(), len(y)
    cov = lambda k: np.sum(e[k:] * e[: n - k])
    c = int(n ** (2 / 9))
    s0 = cov(0) / n + sum(2 * cov(k) / n for k in range(1, c + 1))
    s1 = sum(k * 2 * cov(k) / n for k in range(1, c + 1))
    lag = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    v = (cov(0) + 2 * sum(cov(k) * (1 - k / (lag + 1)) for k in range(1, lag + 1))) / n
    return np.sum(np.cumsum(e) ** 2) / n**2 / v, lag


@pytest.mark.parametrize("size", [16, 65_536])
def test_kpss(panel_of, blocks, waves, size):
    blocks(size)
    out = {r.series_id: r for r in stationarity.kpss(panel_of(waves)).collect()}
    for name, y in waves.items():
        stat, lag = kpss_by_definition(y)
        assert out[name].kpss_lag == lag
        assert out[name].kpss_statistic == pytest.approx(stat, rel=1e-8)
    assert out["walk"].kpss_p_value < 0.05


@pytest.mark.parametrize("size", [50, 65_536])
def test_correlogram(panel_of, blocks, waves, size):
    blocks(size)
    series = {**waves, "n30": waves["wave"][:30], "flat": np.ones(30), "one": [2.0]}
    rows = {r.series_id: r for r in autocorr.correlogram(panel_of(series)).collect()}
    for name in ("wave", "walk", "n30"):
        y = np.asarray(series[name])
        e, n = y - y.mean(), len(y)
        top = min(40, n // 2)
        acf = [np.sum(e[k:] * e[: n - k]) / np.sum(e * e) for k in range(top + 1)]
        np.testing.assert_allclose(rows[name].acf, acf, atol=1e-10)
        g = np.array([np.sum(e[k:] * e[: n - k]) / (n - k) for k in range(top + 1)])
        for k in (1, 2, 5, min(40, n // 2 - 1)):
            system = g[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
            assert rows[name].pacf[k] == pytest.approx(np.linalg.solve(system, g[1 : k + 1])[-1], abs=1e-8)
    features = {r.series_id: r for r in autocorr.lag_features(autocorr.correlogram(panel_of(series))).collect()}
    assert features["wave"].max_acf_lag == 7 or features["wave"].recommended_lags
    for name in ("flat", "one"):
        got = features[name]
        assert (got.lag_1_acf, got.pacf_order, got.recommended_lags, got.max_acf_lag) == (0.0, 1, [1], 1)


def test_student_tail():
    # published two-sided 5 % points
    for dof, t in ((1, 12.7062047), (2, 4.3026527), (10, 2.2281389), (30, 2.0422725), (1000, 1.9623390)):
        assert mathx.student_t_two_sided(np.array([t]), np.array([dof]))[0] == pytest.approx(0.05, abs=1e-7)
    assert mathx.dickey_fuller_p(-2.86) == pytest.approx(0.05, abs=2e-3)
    assert mathx.dickey_fuller_p(3.0) == 1.0 and mathx.dickey_fuller_p(-20.0) == 0.0


def test_profile_edges(panel_of, waves):
    series = {"a": waves["wave"], "flat": [3.0] * 30, "n23": waves["wave"][:23], "n24": waves["wave"][:24], "two": [1.0, 2.0]}
    panel = panel_of(series)
    rows = {r.series_id: r for r in profile.profile(panel, quality.detect_frequency(panel)).collect()}
    assert rows["a"].has_trend and rows["a"].trend_direction == "upward"
    assert rows["a"].has_seasonality and rows["a"].seasonal_period == 7
    line = np.corrcoef(np.arange(23), waves["wave"][:23])[0, 1]
    assert rows["n23"].trend_strength == pytest.approx(abs(line))
    t, _, r = parts_by_definition(waves["wave"][:24], 12)
    want = max(0, 1 - r.var(ddof=1) / (t.var(ddof=1) + r.var(ddof=1)))
    assert rows["n24"].trend_strength == pytest.approx(want)
    assert rows["flat"].trend_direction == "none" and rows["flat"].cv == 0
    assert rows["two"].seasonality_strength == 0 and rows["two"].data_complexity_score == 1
    s = pd.Series(waves["wave"])
    assert rows["a"].std == pytest.approx(s.std())
    d = np.diff(s)
    assert rows["a"].mean_abs_change == pytest.approx(np.abs(d).mean())
    assert rows["a"].std_1st_diff == pytest.approx(d.std())
    assert rows["a"].zero_crossing_rate == pytest.approx(np.sum(np.diff(np.sign(s - s.mean())) != 0) / 400)


def test_profile_joins_written_parts(panel_of, waves):
    """A task that joins the parts runs none of their sorts and aggregations, each of which takes a page of its memory."""
    panel = panel_of({"a": waves["wave"], "b": waves["walk"]})
    made = profile.profile(panel, quality.detect_frequency(panel))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 7 and plan.count("Relation [") == 8
    assert not [x for x in ("Aggregate", "Window", "Generate", "Python", "InPandas", "Repartition", "LogicalRDD") if x in plan]
    assert [r.series_id for r in made.orderBy("series_id").collect()] == ["a", "b"]


def test_calendar_profile_keeps_absent_slots(panel_of):
    panel = panel_of({"a": range(5), "b": range(5)})
    freq = quality.detect_frequency(panel)
    rows = decompose.calendar_profile(panel, freq).where("series_id = 'a'").orderBy("slot").collect()
    # 2020-01-01 is a Wednesday
    assert [r.mean_y for r in rows] == [None, None, 0.0, 1.0, 2.0, 3.0, 4.0]


def test_blocks_spread_over_tasks_and_batches(spark, blocks):
    """Small blocks are dealt by number, not by bytes; a block may lie in several batches."""
    from pyspark import TaskContext

    from seriesloom.functions.blocks import block_vectors

    blocks(10)
    rows = spark.range(300 * 25).selectExpr("cast(id % 300 as string) as series_id", "id div 300 as i", "cast(id as double) as y")
    kernel = lambda pdf, own: [pdf["y"].to_numpy()[own].sum(), own.sum(), len(own), 100.0 ** TaskContext.get().partitionId()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.series_id: r.vec for r in block_vectors(rows, kernel, back=2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 300 and all(v[:3] == [float(sum(range(int(k), 7500, 300))), 25.0, 29.0] for k, v in got.items())
    assert len({v[3] for v in got.values()}) > 4
