import itertools

import pytest

from seriesloom.operators import recommend

SCHEMA = (
    "series_id string, dataset_size long, has_trend boolean, has_seasonality boolean, is_stationary boolean, "
    "data_complexity_score int, seasonal_period int, seasonality_strength double, recommended_lags array<int>, lag_1_acf double"
)


def cases():
    sizes, flags = (99, 100, 500, 501, 999, 1000, 1001, 2999, 3000, 4999, 5000, 5001), (True, False)
    for k, (n, trend, season, calm, score) in enumerate(itertools.product(sizes, flags, flags, flags, (0, 4, 5, 6, 7, 10))):
        yield (f"s{k}", n, trend, season, calm, score, 7 if season else None, 0.5 if season else 0.1, [1, 2, 3, 4], 0.8)


def expected(n, trend, season, calm, score, strength):
    """The rule table, in order."""
    out = []
    if season and not calm and n < 5000:
        out.append(("SARIMA", min(95, 90 + strength * 10)))
    if season and n >= 100:
        out.append(("Prophet", min(92, 80 + strength * 15)))
    if trend and not season and n < 3000:
        out.append(("ARIMA", 85))
    if score < 5 and n < 1000:
        out.append(("Exponential Smoothing (ETS)", 75))
    if n > 1000 or score >= 6:
        out.append(("XGBoost with Lag Features", min(92, 82 + min(score, 10) * 1.5)))
    if n > 5000 and score >= 7:
        out.append(("LSTM (Deep Learning)", min(88, 78 + score * 2)))
    return sorted(out, key=lambda x: -x[1])[:3]


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame(list(cases()), SCHEMA)


def test_every_combination(features):
    got = {}
    for r in recommend.recommendation_rows(recommend.recommend(features)).orderBy("series_id", "rank").collect():
        got.setdefault(r.series_id, []).append((r.name, r.confidence))
    for sid, n, trend, season, calm, score, _, strength, _, _ in cases():
        assert got.get(sid, []) == [(a, pytest.approx(b)) for a, b in expected(n, trend, season, calm, score, strength)]


def test_texts_and_other_tasks(features):
    rows = recommend.recommend(features, [*recommend.TASKS, "Unknown"])
    one = features.where("dataset_size = 5001 and has_trend and has_seasonality and not is_stationary and data_complexity_score = 10")
    sid = one.first().series_id
    by_task = {r.task: r for r in rows.where(f"series_id = '{sid}'").collect()}
    top = by_task["Forecasting"].primary
    assert top.name == "XGBoost with Lag Features"
    assert top.reasons[0] == "Large dataset (5001 observations)" and top.reasons[3] == "Recommended lags: [1, 2, 3]"
    assert by_task["Forecasting"].hybrid_suggestion.combo == "SARIMA + XGBoost Ensemble"
    assert [a.name for a in by_task["Classification"].alternatives] == ["LSTM Classifier", "k-NN with DTW"]
    assert by_task["Anomaly Detection"].primary.name == "STL Decomposition + Z-Score"
    assert [a.confidence for a in by_task["Clustering"].alternatives] == [78, 75]
    assert by_task["Unknown"].primary is None and by_task["Unknown"].alternatives == []


@pytest.mark.parametrize(
    "name, share, final, confidence",
    [
        ("Prophet", 0.7, "Prophet", 0.8 * 0.7 + 0.2 * 0.95),
        ("SARIMA", 0.7, "SARIMA", 0.8 * 0.7 + 0.2 * 0.95 + 0.1),
        ("SARIMA", 0.9, "SARIMA", 0.95),
        ("SARIMA", 0.5, "SARIMA", 0.8 * 0.5 + 0.2 * 0.95 + 0.1),
        ("ETS", 0.5, "ETS", 0.4),
        ("ETS", 0.35, "SARIMA", 0.95),
        (None, 0.9, "SARIMA", 0.95),
    ],
)
def test_decision_cases(spark, features, name, share, final, confidence):
    row = features.where("dataset_size = 500 and has_seasonality and not is_stationary and data_complexity_score = 5").limit(1)
    pick = spark.createDataFrame([(row.first().series_id, name, share)], "series_id string, ai_name string, ai_confidence double")
    out = recommend.decide(recommend.recommend(row), pick).first()
    assert out.final_name == final and out.final_confidence == pytest.approx(confidence)
    methods = [r.method for r in recommend.comparison(recommend.decide(recommend.recommend(row), pick)).collect()]
    assert methods == (["AI Meta-Model"] if name and share > 0.3 else []) + ["Rule-Based", "Final Hybrid"]
