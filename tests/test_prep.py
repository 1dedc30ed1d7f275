import numpy as np
import pandas as pd
import pytest

from seriesloom.operators import prep, quality
from seriesloom.operators.quantiles import quantiles
from seriesloom.sources.panels import build_panel, densify, prepare
from tests.conftest import values_of

GAPS = [None, None, 3.0, None, 7.0, None, None, 1.0, 4.0, None]


@pytest.mark.parametrize("size", [3, 1000])
@pytest.mark.parametrize("method", ["ffill", "bfill", "interpolate", "mean", "drop", "none"])
def test_fill_matches_pandas(panel_of, blocks, size, method):
    blocks(size)
    s = pd.Series(GAPS, dtype=float)
    expected = {
        "ffill": s.ffill().bfill(),
        "bfill": s.bfill().ffill(),
        "interpolate": s.interpolate().ffill().bfill(),
        "mean": s.fillna(s.mean()),
        "drop": s.dropna(),
        "none": s,
    }[method]
    out = prep.fill_missing(panel_of({"a": GAPS, "b": [None] * 4}), method)
    got = pd.Series(values_of(out), dtype=float)
    np.testing.assert_allclose(got.to_numpy(), expected.to_numpy())
    assert values_of(out, "i") == list(range(len(expected)))


@pytest.mark.parametrize("size", [8, 1000])
def test_difference_and_smooth_match_pandas(panel_of, blocks, waves, size):
    blocks(size)
    panel, s = panel_of({"a": waves["wave"]}), pd.Series(waves["wave"])
    np.testing.assert_allclose(values_of(prep.difference(panel, 2)), s.diff().diff().dropna(), atol=1e-9)
    np.testing.assert_allclose(values_of(prep.smooth(panel, 7)), s.rolling(7).mean().bfill())
    assert values_of(prep.difference(panel, 2), "i") == list(range(398))


def test_outliers_and_scaling(panel_of):
    s = pd.Series([1.0, 2, 3, 4, 5, 6, 7, 8, 9, 100])
    panel = panel_of({"a": s, "flat": [5.0] * 10, "low": [-1.0, 0, 1, 2, 3, 4, 5, 6, 7, 8]})
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    np.testing.assert_allclose(
        values_of(prep.treat_outliers(panel, "clip", 1.5)), s.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    )
    z = prep.treat_outliers(panel, "zscore", 2.5)
    assert values_of(z)[-1] == 5.5 and values_of(z, key="flat") == [5.0] * 10
    scaled = values_of(prep.scale(panel, "minmax"))
    assert min(scaled) == 0 and max(scaled) == 1
    for method in ("standard", "minmax"):
        assert values_of(prep.scale(panel, method), key="flat") == [0.0] * 10
    logs = values_of(prep.scale(panel, "log"), key="low")
    np.testing.assert_allclose(logs[0], np.log(1e-6), rtol=1e-6)


def test_log_and_task_defaults(panel_of):
    options = prep.PrepOptions.for_task("Anomaly Detection", differencing=1, smoothing=3)
    assert (options.outliers, options.differencing, options.smoothing) == ("none", 0, 3)
    assert prep.PrepOptions.for_task("Forecasting", smoothing=3).smoothing == 1
    panel = panel_of({"a": GAPS + [4.0] * 10})
    _, log = prep.preprocess(panel, prep.PrepOptions(missing="interpolate", scaling="log", differencing=1))
    lines = [r.message for r in log.orderBy("step").collect()]
    assert lines[0] == "Missing values: 6 → 0 using [Linear interpolation]"
    assert lines[1].startswith("Outliers handled: ~") and lines[1].endswith("[IQR clipping (±3.0 IQR)]")
    assert lines[2] == "Applied log-transform (shifted by 0.0000 to ensure positivity)."
    assert lines[3] == "Applied differencing of order 1."


def test_quantiles_exact_on_a_long_skewed_series(spark):
    rng = np.random.default_rng(1)
    hot = np.concatenate([rng.lognormal(0, 3, 30_000), np.full(15_000, 2.0)])
    rows = spark.createDataFrame(pd.DataFrame({"series_id": "hot", "y": hot})).unionByName(
        spark.createDataFrame(pd.DataFrame({"series_id": "one", "y": [4.0]}))
    )
    got = {r.series_id: r for r in quantiles(rows, {"a": 0.25, "b": 0.5, "c": 0.95, "d": 1.0}).collect()}
    for name, p in (("a", 0.25), ("b", 0.5), ("c", 0.95), ("d", 1.0)):
        assert got["hot"][name] == pytest.approx(np.quantile(hot, p), rel=1e-12)
        assert got["one"][name] == 4.0


@pytest.mark.parametrize(
    "seconds, code",
    [(3600, "H"), (3601, "D"), (86400, "D"), (86401, "W"), (604800, "W"), (604801, "M"), (2678400, "M"),
     (2678401, "Q"), (7948800, "Q"), (7948801, "Y")],
)
def test_frequency_bounds(panel_of, seconds, code):
    panel = panel_of({"a": range(12)}, freq=f"{seconds}s")
    assert quality.detect_frequency(panel).first().frequency == code


def test_validation_messages(spark, panel_of):
    good = panel_of({"ok": range(10), "short": range(9), "half": [1.0] * 5 + [None] * 5, "more": [1.0] * 4 + [None] * 6})
    out = {r.series_id: r for r in quality.validate(good.unionByName(good.where("series_id = 'ok' and i = 0"))).collect()}
    assert out["ok"].errors == ["Duplicate timestamps detected"] and not out["ok"].is_valid
    assert out["short"].errors == ["Dataset too small (minimum 10 observations required)"]
    assert out["half"].is_valid
    assert out["more"].errors == ["Too many missing values in target column (60.0%)"]
    text = quality.validate(good.withColumn("y", good.y.cast("string"))).where("series_id = 'half'").first()
    assert text.errors == ["Target column must be numeric"]


def test_fine_units_rank_like_raw_rows(spark):
    rows = spark.range(300).selectExpr("'a' as k", "timestamp_ntz '2020-01-01' + make_dt_interval(0, 0, 0, id * 20) as t", "1.0D as v")
    out = build_panel(rows, "k", "t", "v", "minute").orderBy("i").collect()
    assert [r.i for r in out] == list(range(100)) and {r.y for r in out} == {3.0}
    with pytest.raises(ValueError):
        densify(build_panel(rows, "k", "t", "v", "minute"), "minute")


def test_prepare_ranks_one_long_series_over_many_tasks(spark):
    n = 20_000
    rows = spark.range(n).selectExpr(
        "'hot' as k", "timestamp_ntz '2020-01-01' + make_dt_interval(0, 0, 0, (id * 7919) % 20000) as t",
        "cast((id * 7919) % 20000 as double) as v",
    )
    out = prepare(rows, "t", "v", "k")
    assert out.where("i <> y").count() == 0 and out.count() == n
