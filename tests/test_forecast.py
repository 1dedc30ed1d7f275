import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions.smoothing import Carrier, Smoother, first_state
from seriesloom.operators.decompose import decompose
from seriesloom.operators.forecast import additive, arima, boosted, ets, hybrid, naive, slots
from seriesloom.operators.forecast.split import metrics, rank_models, split, holdout_rows, train_rows
from seriesloom.operators.stationarity import adf
from seriesloom.panel import attach
from seriesloom.plans.benchmark import ALL, Bench, Run, compare, forecast_frame
from seriesloom.session import written
from seriesloom.sources import models
from tests.conftest import values_of


def seasons(spark, **periods):
    return spark.createDataFrame(list(periods.items()), "series_id string, seasonal_period int")


def simulated_arima(n=3000, phi=0.6, theta=0.3, seed=3):
    rng = np.random.default_rng(seed)
    e, w = rng.normal(0, 1, n), np.zeros(n)
    for t in range(1, n):
        w[t] = phi * w[t - 1] + e[t] + theta * e[t - 1]
    return np.cumsum(w)


def test_split_is_ordered(panel_of):
    parts = split(panel_of({"a": range(11), "b": range(2)}), 0.75)
    assert values_of(train_rows(parts)) == list(range(8))
    assert values_of(holdout_rows(parts), "h") == [1, 2, 3]
    assert values_of(train_rows(parts), key="b") == [0.0]


@pytest.mark.parametrize("size", [700, 65_536])
def test_arima_recovers_coefficients(panel_of, blocks, size):
    blocks(size)
    y = simulated_arima()
    parts = split(panel_of({"a": y, "tiny": y[:8]}), 0.9)
    params = arima.fit(train_rows(parts))
    rows = {r.series_id: r for r in params.collect()}
    assert rows["a"].phi == pytest.approx(0.6, abs=0.08) and rows["a"].theta == pytest.approx(0.3, abs=0.1)
    assert rows["tiny"].status == "failed" and rows["tiny"].error
    out = arima.predict(params, holdout_rows(parts))
    got = values_of(out, "yhat")
    r = rows["a"]
    level, w, e = r.y_tail[-1], r.w_tail[-1], r.e_tail[-1]
    for h in range(5):
        w, e = r.phi * w + r.theta * e, 0.0
        level += w
        assert got[h] == pytest.approx(level)


def test_sarima_follows_a_clean_season_and_its_segments_join(panel_of, spark, monkeypatch):
    t = np.arange(300)
    y = 20 + 0.5 * t + 5 * np.sin(2 * np.pi * t / 12) + np.random.default_rng(0).normal(0, 0.1, 300)
    parts = split(panel_of({"a": y}), 0.8, seasons(spark, a=12))
    params = arima.fit(train_rows(parts), seasonal=True)
    whole = values_of(arima.predict(params, holdout_rows(parts)), "yhat")
    assert np.abs(np.array(whole) - y[240:]).mean() < 0.5
    r = params.first()
    step = arima._transition(r, 13)
    state = np.concatenate([np.asarray(v)[::-1] for v in (r.w_tail, r.e_tail, r.y_tail)])
    np.testing.assert_allclose((np.linalg.matrix_power(step, 37) @ state)[26], whole[36])


@pytest.mark.parametrize("size", [128, 65_536])
def test_smoothing_is_exact_on_line_plus_season(panel_of, spark, blocks, size):
    blocks(size)
    t = np.arange(280)
    y = 10 + 0.3 * t + np.tile([0, 3, -1, 2, -4, 1, -1], 40)
    parts = split(panel_of({"a": y, "short": y[:16]}), 0.8, seasons(spark, a=7, short=7))
    params = ets.fit(train_rows(parts))
    assert {r.series_id: r.status for r in params.collect()} == {"a": "success", "short": "failed"}
    np.testing.assert_allclose(values_of(ets.predict(params, holdout_rows(parts)), "yhat"), y[224:], atol=1e-6)


def test_smoothing_blocks_agree_with_one_pass(panel_of, spark, blocks):
    rng = np.random.default_rng(5)
    t = np.arange(6000)
    y = 100 + 4 * np.sin(2 * np.pi * t / 7) + np.cumsum(rng.normal(0, 0.3, 6000))
    panel = panel_of({"a": y})
    found = []
    for size in (2500, 65_536):
        blocks(size)
        found.append(ets.fit(train_rows(split(panel, 1.0, seasons(spark, a=7)))).first())
    assert [found[0][c] for c in ("alpha", "beta", "gamma")] == [found[1][c] for c in ("alpha", "beta", "gamma")]
    assert found[0].sse == pytest.approx(found[1].sse, rel=1e-6)
    assert found[0].level + found[0].pattern[0] == pytest.approx(found[1].level + found[1].pattern[0], rel=1e-6)


@pytest.mark.parametrize("season", [1, 7, 365, 1000])
def test_smoothing_keeps_its_whole_past(panel_of, spark, blocks, season):
    """Blocks shorter and longer than the season, the last one far shorter than two seasons, against the recursion row by row."""
    rng = np.random.default_rng(8)
    t = np.arange(3100)
    y = 100 + 9 * np.sin(2 * np.pi * t / max(season, 30)) + np.cumsum(rng.normal(0, 0.3, t.size))
    train = train_rows(split(panel_of({"a": y, "b": y[:2600] ** 1.1}), 1.0, seasons(spark, a=season, b=season)))
    seasonal = season > 1
    known = spark.createDataFrame([(k, "success", 0.4, 0.2) for k in "ab"], "series_id string, status string, phi double, theta double")
    for size in (600, 1500, 65_536):
        blocks(size)
        params = ets.fit(train, seasonal)
        found = {r.series_id: r for r in params.collect()}
        for name, values in (("a", y), ("b", y[:2600] ** 1.1)):
            r = found[name]
            level, slope, pattern = first_state(values, season)
            gamma, sse, smooth = min(r.gamma, 0.9 * (1 - r.alpha)) if seasonal else 0.0, 0.0, []
            for k in range(values.size):
                smooth.append(level + slope + pattern[k % season])
                error = values[k] - smooth[-1]
                level, slope = level + slope + r.alpha * error, slope + r.alpha * r.beta * error
                pattern[k % season] += gamma * error
                sse += error * error
            assert (r.level, r.slope, r.sse) == pytest.approx((level, slope, sse), rel=1e-9, abs=1e-9)
            np.testing.assert_allclose(r.pattern, pattern, rtol=1e-9, atol=1e-9)
            if name == "a" and seasonal:
                fits = values_of(hybrid.base_fits(train, known, params), "base")
                np.testing.assert_allclose(fits, 0.5 * (np.array(smooth) + arima.fitted_kernel(values, 0, 0.4, 0.2, 0.0, 0.0)), rtol=1e-9)


def test_long_series_without_a_fit(panel_of, spark, blocks):
    blocks(100)
    y = 10 + np.sin(np.arange(350.0))
    gap = y.copy()
    gap[222] = np.nan
    train = train_rows(split(panel_of({"gap": gap, "few": y, "good": y}), 1.0, seasons(spark, gap=7, few=200, good=7)))
    assert {r.series_id: r.error for r in ets.fit(train).collect()} == {"gap": ets.MISSING, "few": ets.TOO_SHORT, "good": None}


@pytest.mark.parametrize("season", [30, 700])
def test_lags_longer_than_blocks(panel_of, spark, blocks, season):
    """Seasons below and beyond the block give the same model and the same decomposition at every block size."""
    rng = np.random.default_rng(4)
    t = np.arange(3600)
    y = 50 + 6 * np.sin(2 * np.pi * t / season) + np.cumsum(rng.normal(0, 0.2, t.size))
    parts = split(panel_of({"a": y, "b": y[:3300] ** 1.2}), 0.9, seasons(spark, a=season, b=season))
    found = []
    for size in (100, 1000, 65_536):
        blocks(size)
        params = arima.fit(train_rows(parts), seasonal=True).orderBy("series_id").collect()
        assert [r.status for r in params] == ["success"] * 2 and params[0].long_lags == [1, 2, 3, season, season + 1, 2 * season]
        made = decompose(parts, "season").orderBy("series_id", "i").select("trend", "seasonal", "resid").toPandas()
        assert not made.isna().any().any()
        tau = [r.adf_statistic for r in adf(parts.select("series_id", "ts", "i", "y")).orderBy("series_id").collect()]
        found.append(([[r.phi, r.theta, r.seasonal_phi, r.seasonal_theta, *r.e_tail, *r.w_tail] for r in params], made.to_numpy(), tau))
    for other in found[:2]:
        for x, z in zip(other, found[2]):
            np.testing.assert_allclose(x, z, rtol=1e-6, atol=1e-7)


def test_carried_states_equal_zero_rows():
    rng = np.random.default_rng(1)
    for m, n, i in ((1, 50, 3), (2, 7, 1), (7, 49, 5), (7, 5, 2), (12, 12, 0), (365, 1000, 17), (1000, 900, 77)):
        rates = ets.grid(m > 1)
        states = rng.normal(0, 1, (len(rates), m + 2))
        if m == 1:
            states[:, 2] = 0
        smoother = Smoother(m, rates).place(states)
        smoother.run(np.zeros(n), i)
        carrier = Carrier(m, n, rates)
        np.testing.assert_allclose(carrier.carry(states, i), smoother.states(), atol=1e-12)
        np.testing.assert_allclose(carrier.carry(states[3:4], i, slice(3, 4)), smoother.states()[3:4], atol=1e-12)


def test_additive_and_seasonal_smoothing(panel_of, spark):
    t = np.arange(730)
    y = 50 + 0.05 * t + 6 * np.sin(2 * np.pi * t / 7)
    parts = split(panel_of({"a": y}), 0.8, seasons(spark, a=7))
    odd = values_of(ets.predict(hybrid.fit_seasonal_ets(train_rows(split(panel_of({"a": y}), 0.8, seasons(spark, a=14))), [14]), holdout_rows(parts)), "yhat")
    assert np.abs(np.array(odd) - y[584:]).mean() < 0.6
    for fit, predict in ((additive.fit, additive.predict), (hybrid.fit_seasonal_ets, ets.predict)):
        got = np.array(values_of(predict(fit(train_rows(parts)), holdout_rows(parts)), "yhat"))
        assert np.abs(got - y[584:]).mean() < 0.6


def test_lag_frame_and_boosting(panel_of, spark):
    t = np.arange(200)
    y = np.sin(2 * np.pi * t / 10) * 5 + 20
    parts = split(panel_of({"a": y, "b": y * 1000}), 0.8)
    frame = boosted.lag_frame(parts, [1, 10])
    assert values_of(frame, "lag_10") == pytest.approx(list(y[:190]))
    assert frame.where("series_id = 'a' and is_train").count() == 152
    rows, model = boosted.fit_predict(parts, [1, 2, 3], rounds=10)
    score = {r.series_id: r for r in metrics(rows.selectExpr("*", "'XGBoost' as model")).collect()}
    assert score["a"].r2 > 0.7 and score["b"].r2 == pytest.approx(score["a"].r2, rel=0.05)
    names = [r.feature for r in boosted.importances(model, ["lag_1", "lag_2", "lag_3"], spark).collect()]
    assert sorted(names) == ["lag_1", "lag_2", "lag_3"]


def lags_of(spark, **chosen):
    return spark.createDataFrame(list(chosen.items()), "series_id string, recommended_lags array<int>")


@pytest.mark.parametrize("size", [7, 1000])
def test_lag_slots(panel_of, spark, blocks, size):
    """Lags per series, also longer than a block; the last lag fills empty slots, no lags mean lag 1."""
    blocks(size)
    y = [float(v) for v in np.random.default_rng(3).normal(size=40)]
    holed = [*y[:10], None, *y[11:]]
    parts = split(panel_of({"a": y, "b": holed, "c": y, "d": y[:5]}), 0.8)
    got = slots.slot_frame(parts, lags_of(spark, a=[2, 20], b=[3, 1], d=[9]), 0.8).toPandas().sort_values(["series_id", "i"])
    for name, values, lags in (("a", y, [2, 20, 20, 20, 20]), ("b", holed, [3, 1, 1, 1, 1]), ("c", y, [1] * 5)):
        want = [(i, values[i], *[values[i - k] for k in lags]) for i in range(max(lags), 40)]
        want = [row for row in want if None not in row]
        mine = got[got.series_id == name]
        assert [tuple(r) for r in mine[["i", "y", *slots.NAMES]].itertuples(index=False)] == want
        top = max(lags)
        assert list(mine.is_train) == [i - top < int((40 - top) * 0.8) for i in mine.i]
    assert "d" not in set(got.series_id)


def test_saved_trees_run_ahead(panel_of, spark, tmp_path):
    """A loaded model repeats the forecasts of Spark's own trees, step by step on their own output."""
    t = np.arange(120)
    y = {"a": np.sin(2 * np.pi * t / 10) * 5 + 20, "b": np.cos(2 * np.pi * t / 6) * 900, "short": np.arange(6.0)}
    y["late"] = np.where(t == 95, np.nan, y["a"])
    parts = split(panel_of(y), 0.8)
    lags = lags_of(spark, a=[1, 10], b=[6, 3], short=[8], late=[1, 2])
    bench = Bench(panel_of(y), 0.8, lags=lags, rounds=6)
    run = bench.run("XGBoost")
    failed = {r.series_id: r.error for r in run.status.where("status = 'failed'").collect()}
    assert failed == {"short": "too few rows for the lags", "late": "missing values at the end of training"}
    models.save_model(run.params["XGBoost"], str(tmp_path), "XGBoost")
    loaded = models.load_model(spark, str(tmp_path), "xgboost")
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, str(tmp_path / "none"), "XGBoost")

    params = {r.series_id: r for r in loaded.params.where("status = 'success'").collect()}
    assert {k: p.n_train for k, p in params.items()} == {"a": 10 + 88, "b": 6 + 91}
    steps = 150
    future = spark.createDataFrame(
        [(k, None, int(p.n_train) + h - 1, h) for k, p in params.items() for h in range(1, steps + 1) if k == "a" or h <= 3],
        "series_id string, ts timestamp_ntz, i long, h long",
    )
    made = slots.predict(loaded, future).orderBy("series_id", "h").collect()
    value = slots._forest(loaded.trees.toPandas())
    for name, last in (("a", steps), ("b", 3)):
        p = params[name]
        past = [(v - p.centre) / p.spread for v in y[name][: p.n_train]]
        for _ in range(last):
            past.append(value(np.array([[past[-k] for k in p.lags]]))[0])
        want = np.array(past[p.n_train :]) * p.spread + p.centre
        np.testing.assert_allclose([r.yhat for r in made if r.series_id == name], want)
    # the first step sees the same slots as the one-step forecasts of Spark's model
    first = {r.series_id: r.yhat for r in run.forecasts.where("h = 1").collect()}
    for name in "ab":
        assert [r.yhat for r in made if r.series_id == name and r.h == 1] == pytest.approx([first[name]])


def test_metrics_edges(spark):
    rows = [("a", "m", 2.0, 2.0), ("a", "m", 2.0, 2.0), ("b", "m", 2.0, 3.0), ("b", "m", 2.0, 2.0), ("c", "m", 0.0, 1.0), ("c", "m", 4.0, 3.0)]
    out = {r.series_id: r for r in metrics(spark.createDataFrame(rows, "series_id string, model string, y double, yhat double")).collect()}
    assert out["a"].r2 == 1.0 and out["b"].r2 == 0.0
    assert out["c"].mae == 1.0 and out["c"].rmse == 1.0 and out["c"].r2 == pytest.approx(0.75)
    assert out["c"].mape == pytest.approx(100 * (1e8 + 0.25) / 2)


def test_ranking_breaks_ties_by_name(spark):
    rows = [("a", "z", 1.0), ("a", "b", 1.0), ("a", "c", 2.0)]
    out = rank_models(spark.createDataFrame(rows, "series_id string, model string, mae double")).orderBy("rank").collect()
    assert [r.model for r in out] == ["b", "z", "c"] and [r.is_best for r in out] == [True, False, False]


def test_benchmark_ranks_all_and_reports_failures(panel_of, spark, waves):
    bench = Bench(panel_of({"wave": waves["wave"], "tiny": waves["wave"][:12]}), 0.8, seasons(spark, wave=7, tiny=7), rounds=3)
    result = compare(bench, [*ALL, "Seasonal Naive"])
    scores = result.scores.where("series_id = 'wave'").orderBy("rank").collect()
    assert [r["rank"] for r in scores] == list(range(1, 9))
    assert [r.mae for r in scores] == sorted(r.mae for r in scores)
    assert {r["mode"] for r in scores if r.model == "XGBoost"} == {"one-step"}
    failed = {(r.series_id, r.model) for r in result.failed.collect()}
    assert {("tiny", "SARIMA"), ("tiny", "Exponential Smoothing"), ("tiny", "XGBoost")} <= failed
    assert not any(s == "wave" for s, _ in failed)
    shown = {r.model for r in forecast_frame(bench, result.forecasts).where("series_id = 'wave'").select("model").distinct().collect()}
    assert "XGBoost" not in shown and "SARIMA" in shown


def test_saved_models(panel_of, spark, tmp_path, waves):
    parts = split(panel_of({"a": waves["wave"]}), 0.8, seasons(spark, a=7))
    path = models.save_model(ets.fit(train_rows(parts)), str(tmp_path), "Exponential Smoothing")
    assert path.endswith("/exponential_smoothing")
    loaded = models.load_model(spark, str(tmp_path), "exponential smoothing")
    new = holdout_rows(parts).selectExpr("series_id", "ts", "h - 1 as i", "y")
    ends = spark.createDataFrame([("a", 320)], "series_id string, n_train long")
    out = models.score_saved(loaded, "exponential_smoothing", new, ends).orderBy("h").collect()
    assert len(out) == 80 and np.mean([abs(r.actual - r.predicted) for r in out]) < 3
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, str(tmp_path), "missing")
    with pytest.raises(ValueError):
        models.score_saved(loaded, "xgboost", new, ends)


def test_naive(panel_of, spark):
    parts = split(panel_of({"a": list(range(10)), "b": [1.0, 2.0]}), 0.8)
    params = naive.fit(train_rows(parts), 3)
    assert values_of(naive.predict(params, holdout_rows(parts)), "yhat") == [5.0, 6.0]
    assert {r.series_id: r.status for r in params.collect()}["b"] == "failed"


@pytest.mark.parametrize("period", [30, 365])
def test_hybrid_for_seasons_outside_the_table(panel_of, spark, period):
    t = np.arange(4 * period)
    y = 10 + 0.2 * t + 5 * np.sin(2 * np.pi * t / period)
    bench = Bench(panel_of({"a": y}), 0.75, seasons(spark, a=period))
    run = bench.run("STL + ETS (Hybrid)")
    assert [r.status for r in run.status.collect()] == ["success"]
    assert metrics(run.forecasts).first().mae < 1e-6


def test_sarima_with_long_seasons_never_raises(panel_of, spark, blocks):
    t = np.arange(1500)
    y = np.sin(2 * np.pi * t / 300) + 0.01 * t
    params = {r.series_id: r for r in arima.fit(train_rows(split(panel_of({"a": y, "b": y}), 0.98, seasons(spark, a=300, b=12))), seasonal=True).collect()}
    assert params["a"].status == params["b"].status == "success"
    # lags longer than a block change nothing
    blocks(400)
    again = {r.series_id: r for r in arima.fit(train_rows(split(panel_of({"a": y, "b": y}), 0.98, seasons(spark, a=300, b=12))), seasonal=True).collect()}
    for name in "ab":
        assert again[name].status == "success" and again[name].phi == pytest.approx(params[name].phi, abs=1e-6)


def test_forecast_frame_with_equal_times(spark):
    rows = [("a", f"2024-01-{1 + i // 2:02d} 00:00:00", i, float(i)) for i in range(40)]
    panel = spark.createDataFrame(rows, "series_id string, t string, i long, y double").selectExpr("series_id", "cast(t as timestamp_ntz) ts", "i", "y")
    bench = Bench(panel, 0.8, seasons(spark, a=2))
    frame = forecast_frame(bench, bench.run("Seasonal Naive").forecasts)
    assert frame.count() == 8


def test_trees_are_the_same_for_any_number_of_shuffle_partitions(spark, panel_of, waves):
    parts = split(panel_of(waves), 0.8)
    before, made = spark.conf.get("spark.sql.shuffle.partitions"), []
    for number in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", number)
        rows, _ = boosted.fit_predict(parts, [1, 2, 3], rounds=5)
        made.append([r.yhat for r in rows.orderBy("series_id", "i").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made[0] == made[1]


def test_training_rows_are_dealt_by_their_number(spark, panel_of, waves):
    rows = panel_of(waves)
    few, more = boosted.dealt(rows, ["y"]), boosted.dealt(rows, ["y"], 100)
    assert few.rdd.getNumPartitions() == 1 and more.rdd.getNumPartitions() == 8
    assert sorted(r.y for r in more.collect()) == sorted(r.y for r in rows.collect())


def test_trees_run_beside_the_other_models(spark):
    """The trees wait for a model that comes after them in the list."""
    begun = threading.Event()
    columns = "series_id string, model string, mode string, h long, ts timestamp, i long, y double, yhat double"

    class Waiting:
        def run(self, name):
            if name == "XGBoost":
                assert begun.wait(60)
            else:
                begun.set()
            rows = spark.createDataFrame([("a", name, "m", 1, None, 8, 2.0, 2.0 + len(name))], columns)
            status = spark.createDataFrame([("a", name, "success", None)], "series_id string, model string, status string, error string")
            return Run(name, rows, status)

    result = compare(Waiting(), ["XGBoost", "SARIMA"])
    assert [(r.model, r.mae, r["rank"]) for r in result.scores.orderBy("rank").collect()] == [("SARIMA", 6.0, 1), ("XGBoost", 7.0, 2)]
    assert {r.model for r in result.forecasts.collect()} == {"XGBoost", "SARIMA"}


def test_short_series_are_fitted_in_several_tasks(spark, panel_of):
    """By their bytes all of them would meet in one."""
    rng = np.random.default_rng(1)
    train = train_rows(split(panel_of({f"s{k}": rng.normal(10, 1, 40) for k in range(30)}), 0.8))
    for fitted in (ets.fit(train, rates=[(0.3, 0.1, 0.2)]), arima.fit(train)):
        rows = fitted.select("series_id", "status", F.spark_partition_id().alias("task")).collect()
        assert len(rows) == 30 and {r.status for r in rows} == {"success"} and len({r.task for r in rows}) > 2


def test_rows_are_not_broadcast(spark, panel_of):
    """Neither the rows of a panel beside their values per series, nor the steps of a forecast."""
    panel = written(panel_of({"a": list(range(30)), "b": list(range(30))}), "panel")
    stats = written(panel.groupBy("series_id").agg(F.max("i").alias("last_i"), F.avg("y").alias("m")), "stats")
    rows = attach(panel, stats)
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.where("m = 14.5").count() == 60
    # a season takes the forecast through segments of steps
    bench = Bench(panel, 0.8, stats.select("series_id", F.lit(2).alias("seasonal_period")))
    plan = bench.run("Exponential Smoothing").forecasts._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
