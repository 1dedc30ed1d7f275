"""Entry points, and a sample of queries against their SQL on the smallest tables."""

from datetime import datetime
from types import SimpleNamespace

import pytest

import __spark_entry__ as entry
from seriesloom.plans import catalog
from seriesloom.sources import files
from tools.check import connect, difference

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "panel_daily", "preview_rows", "prepared_series", "csv_round_trip", "frequency", "validation", "basic_stats",
    "fill_interpolate", "outliers_zscore", "prep_chain", "prep_log", "features_all", "decomposition", "acf_pacf_frame",
    "level_stationarity", "stat_cards", "rules_forecasting", "hybrid_decision", "model_ranking", "lag_frame",
    "anomalies_residual", "cluster_density", "sliding_sequences",
]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and all(r.frequency in "DW" and r.primary_name for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    mine = entry.queries()[name](spark, SF).toPandas()
    assert difference(mine, connect(SF).execute(entry.oracle_sql()[name]).df()) is None


def test_csv_reading(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,when,name,value\n1,2024-01-05,x,1.5\n2,2024-01-04,y,\n")
    df, error = files.load_csv(spark, str(path))
    assert error is None
    assert files.detect_time_column(df) == "when" and files.numeric_columns(df) == ["id", "value"]
    assert files.shape(df).first().n_rows == 2
    assert [r.id for r in files.preview(df, "when", 1).collect()] == [2]
    missing, error = files.load_csv(spark, str(tmp_path / "none.csv"))
    assert missing is None and error
    texts = spark.createDataFrame([("a", "12/31/2024"), ("b", None)], "k string, t string")
    assert files.detect_time_column(texts) == "t"
    assert files.detect_time_column(texts.select("k")) is None


def test_training_series_are_built_once(spark, tmp_path, monkeypatch):
    """The profile and the forecasters of the classifier's queries read one panel; its parts are not broadcast."""
    lines = [(k % 3, k % 2, datetime(2020, 1 + k % 12, 1), float(k)) for k in range(60)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_shipdate timestamp_ntz, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"B{k % 2}", "T") for k in range(3)], "p_partkey long, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    panels, build = [], catalog.build_panel

    def built(*given):
        panels.append(build(*given))
        return panels[-1]

    monkeypatch.setattr(catalog, "build_panel", built)
    monkeypatch.setattr(catalog.profile, "profile", lambda panel, frequencies: panel.select("series_id").distinct().join(frequencies.select("series_id"), "series_id"))
    monkeypatch.setattr(catalog, "compare", lambda bench, names: SimpleNamespace(scores=bench.parts.select("series_id").distinct()))
    monkeypatch.setattr(catalog, "Bench", lambda panel, ratio, features: SimpleNamespace(parts=panel.join(features, "series_id")))
    monkeypatch.setattr(catalog.meta, "training_set", lambda features, scores: features.join(scores, "series_id"))
    features, training = catalog._learned(spark, str(tmp_path))
    names = ["brand B0", "brand B1", "supplier 0", "supplier 1", "type T"]
    assert [r[0] for r in features.orderBy("series_id").collect()] == names == [r[0] for r in training.orderBy("series_id").collect()]
    assert len(panels) == 1
    assert "Broadcast" not in panels[0]._jdf.queryExecution().executedPlan().toString()
