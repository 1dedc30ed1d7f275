"""Every operator as a named query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators import autocorr, decompose, evidence, meta, prep, profile, quality, recommend, stationarity
from seriesloom.operators.forecast import arima, boosted, ets, naive, slots
from seriesloom.operators.forecast.split import metrics, metrics_frame, rank_models, split, holdout_rows, train_rows
from seriesloom.operators.quantiles import quantiles
from seriesloom.operators.tasks import anomalies, classify, cluster, sequences
from seriesloom.panel import KEY, attach, lengths
from seriesloom.plans.analyze import analyze
from seriesloom.plans.benchmark import ALL, FAST, Bench, compare, forecast_frame
from seriesloom.sources import files, models
from seriesloom.sources.panels import build_panel, densify, from_vectors, prepare
from seriesloom.session import workspace, written

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- panels over the tables


def daily(spark, sf):
    return build_panel(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "day")


def monthly(spark, sf):
    return build_panel(table(spark, sf, "lineitem"), "l_returnflag", "l_shipdate", "l_quantity", "month")


def hourly(spark, sf):
    return build_panel(table(spark, sf, "events"), "event_type", "ts", "value", "hour", how="avg")


def gappy(spark, sf):
    """Hourly means with null rows for the hours without events."""
    return densify(hourly(spark, sf), "hour")


def mixed(spark, sf):
    """Daily, monthly and hourly series side by side."""
    return daily(spark, sf).unionByName(monthly(spark, sf)).unionByName(hourly(spark, sf))


def vectors(spark, sf):
    return from_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding")


def vector_labels(spark, sf):
    rows = table(spark, sf, "embeddings")
    return rows.select(F.col("vec_id").cast("string").alias(KEY), F.col("label").cast("string").alias("label"))


def stored(spark, sf, make) -> DataFrame:
    """The panel written once per session and scale, since several steps read it."""
    return shared(spark, sf, make.__name__, lambda: make(spark, sf))


def shared(spark, sf, name, make) -> DataFrame:
    place = (spark.sparkContext.applicationId, sf, name)
    if place not in _SHARED:
        _SHARED[place] = written(make(), name)
    return _SHARED[place]


def clear_shared() -> None:
    _SHARED.clear()


_SHARED: dict[tuple, DataFrame] = {}


def frequencies_of(spark, sf, make) -> DataFrame:
    return shared(spark, sf, f"{make.__name__}_freq", lambda: quality.detect_frequency(stored(spark, sf, make)))


def plain_features(spark, sf):
    """Profile of the mixed panel with the plain unit-root test, whose statistic SQL can follow."""
    return shared(
        spark, sf, "features",
        lambda: profile.profile(stored(spark, sf, mixed), frequencies_of(spark, sf, mixed), adf_max_lag=0),
    )


# ---------------------------------------------------------------- output shape


def tidy(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Whole numbers as long, doubles rounded, so both engines print the same values."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), special.get(f.name, digits)) + 0.0
        out.append(c.alias(f.name))
    return df.select(*out)


def joined_texts(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.array_join(name, "; "))
    return df


CATALOG: dict[str, Query] = {}


def query(fn: Query) -> Query:
    CATALOG[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- sources


@query
def panel_daily(spark, sf):
    return tidy(daily(spark, sf), 2)


@query
def panel_monthly(spark, sf):
    return tidy(monthly(spark, sf), 2)


@query
def panel_hourly(spark, sf):
    return tidy(hourly(spark, sf), 6)


@query
def preview_rows(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    return tidy(files.preview(rows, "ts"), 4)


@query
def table_shape(spark, sf):
    return tidy(files.shape(table(spark, sf, "events")))


@query
def prepared_series(spark, sf):
    """Raw event rows as one series per type, ordered and forward filled."""
    rows = prepare(table(spark, sf, "events"), "ts", "value", "event_type")
    return tidy(prep.fill_missing(rows, "ffill"), 4)


@query
def csv_round_trip(spark, sf):
    """Write the monthly panel as CSV, read it back with inferred types, detect its columns, prepare it."""
    import uuid

    path = f"{workspace(spark)}/csv-{uuid.uuid4().hex}"
    files.save_csv(monthly(spark, sf).select(KEY, "ts", "y"), path)
    rows, _ = files.load_csv(spark, path)
    time, value = files.detect_time_column(rows), files.numeric_columns(rows)[0]
    return tidy(prepare(rows, time, value, KEY), 2)


# ---------------------------------------------------------------- quality


@query
def frequency(spark, sf):
    return tidy(quality.detect_frequency(mixed(spark, sf)), 3)


@query
def validation(spark, sf):
    return tidy(joined_texts(quality.validate(gappy(spark, sf)), "errors"))


@query
def validation_raw(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias(KEY), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("y")
    )
    return tidy(joined_texts(quality.validate(rows), "errors"))


@query
def basic_stats(spark, sf):
    return tidy(quality.basic_stats(gappy(spark, sf)), 5)


# ---------------------------------------------------------------- preprocessing


def _fill(method):
    def run(spark, sf):
        return tidy(prep.fill_missing(gappy(spark, sf), method), 5)

    return run


for _m in ("ffill", "bfill", "interpolate", "mean", "drop", "none"):
    CATALOG[f"fill_{_m}"] = _fill(_m)


@query
def outliers_clip(spark, sf):
    return tidy(prep.treat_outliers(hourly(spark, sf), "clip", 1.5), 5)


@query
def outliers_zscore(spark, sf):
    return tidy(prep.treat_outliers(hourly(spark, sf), "zscore", 3.0), 5)


@query
def outliers_none(spark, sf):
    return tidy(prep.treat_outliers(hourly(spark, sf), "none"), 5)


def _scale(method):
    def run(spark, sf):
        return tidy(prep.scale(daily(spark, sf), method), 6 if method != "none" else 2)

    return run


for _m in ("standard", "minmax", "log", "none"):
    CATALOG[f"scale_{_m}"] = _scale(_m)


@query
def scale_log_shifted(spark, sf):
    """Log transform of first differences, which go below zero."""
    return tidy(prep.scale(prep.difference(monthly(spark, sf)), "log"), 4)


@query
def difference_once(spark, sf):
    return tidy(prep.difference(daily(spark, sf), 1), 2)


@query
def difference_twice(spark, sf):
    return tidy(prep.difference(daily(spark, sf), 2), 2)


@query
def smooth_rolling(spark, sf):
    return tidy(prep.smooth(daily(spark, sf), 7), 2)


def _chain(spark, sf):
    options = prep.PrepOptions.for_task(
        "Forecasting", missing="interpolate", threshold=1.5, scaling="standard", differencing=1
    )
    return prep.preprocess(gappy(spark, sf), options)


@query
def prep_chain(spark, sf):
    return tidy(_chain(spark, sf)[0], 5)


@query
def prep_log(spark, sf):
    return tidy(_chain(spark, sf)[1])


# ---------------------------------------------------------------- features and tests


@query
def exact_quantiles(spark, sf):
    """Quartiles of raw order values per priority."""
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias(KEY), F.col("o_totalprice").alias("y"))
    return tidy(quantiles(rows, {"q1": 0.25, "median": 0.5, "q3": 0.75}), 3)


@query
def features_basic(spark, sf):
    panel = stored(spark, sf, mixed)
    freq = frequencies_of(spark, sf, mixed).select(KEY, "frequency")
    return tidy(profile.basic_features(panel).join(freq, KEY))


@query
def features_statistical(spark, sf):
    return tidy(profile.statistical_features(stored(spark, sf, mixed)), 3, skewness=6, kurtosis=6, cv=6)


@query
def trend_line(spark, sf):
    return tidy(profile.trend_line(stored(spark, sf, mixed)).drop("dof"), 4, r=7, t=6, p_value=6)


@query
def trend_flags(spark, sf):
    return tidy(profile.trend_flags(profile.trend_line(stored(spark, sf, mixed))), 5, trend_linearity=7)


@query
def trend_strength(spark, sf):
    panel = stored(spark, sf, mixed)
    return tidy(profile.trend_strength(panel, profile.trend_line(panel)), 6)


@query
def seasonality(spark, sf):
    panel = stored(spark, sf, mixed)
    return tidy(profile.seasonality_features(panel, frequencies_of(spark, sf, mixed)), 6)


@query
def unit_root_plain(spark, sf):
    return tidy(stationarity.adf(stored(spark, sf, mixed), max_lag=0), 5)


@query
def unit_root_sums(spark, sf):
    """Cross products of the augmented regression with lag orders up to 3, per entry."""
    sums = stationarity.adf_sums(stored(spark, sf, mixed), max_lag=3)
    entries = sums.select(KEY, F.posexplode(F.slice("vec", 1, 36)).alias("entry", "total"))
    return tidy(entries, 6)


@query
def unit_root_test(spark, sf):
    return tidy(stationarity.adf(stored(spark, sf, mixed)), 6)


@query
def level_stationarity(spark, sf):
    return tidy(stationarity.kpss(stored(spark, sf, mixed)), 6)


@query
def acf_values(spark, sf):
    frame = autocorr.correlogram_frame(autocorr.correlogram(stored(spark, sf, mixed)))
    return tidy(frame.select(KEY, "lag", "acf", "lower", "upper"), 7)


@query
def acf_pacf_frame(spark, sf):
    return tidy(autocorr.correlogram_frame(autocorr.correlogram(stored(spark, sf, mixed))), 6)


@query
def lag_features(spark, sf):
    rows = autocorr.lag_features(autocorr.correlogram(stored(spark, sf, mixed)))
    return tidy(rows.withColumn("recommended_lags", evidence.list_text(F.col("recommended_lags"))), 6)


@query
def change_features(spark, sf):
    return tidy(profile.change_features(stored(spark, sf, mixed)), 3, zero_crossing_rate=7)


@query
def features_all(spark, sf):
    rows = plain_features(spark, sf)
    rows = rows.withColumn("recommended_lags", evidence.list_text(F.col("recommended_lags")))
    return tidy(
        rows, 5, mean=3, median=3, std=3, min=2, max=2, trend_slope=4, mean_abs_change=3, std_1st_diff=3, adf_statistic=5
    )


@query
def complexity_score(spark, sf):
    return tidy(plain_features(spark, sf).select(KEY, "data_complexity_score"))


@query
def features_json(spark, sf):
    rows = plain_features(spark, sf).select(KEY, "dataset_size", "frequency", "has_trend", "has_seasonality")
    return evidence.as_json(rows)


@query
def features_full(spark, sf):
    """Profile with the augmented test and automatic lag order."""
    panel = stored(spark, sf, mixed)
    rows = profile.profile(panel, frequencies_of(spark, sf, mixed))
    return tidy(rows.withColumn("recommended_lags", evidence.list_text(F.col("recommended_lags"))), 5)


# ---------------------------------------------------------------- decomposition, frames, evidence


@query
def decomposition(spark, sf):
    """With the period of each series' frequency."""
    panel = stored(spark, sf, hourly)
    periods = frequencies_of(spark, sf, hourly).select(KEY, quality.seasonal_period(F.col("frequency")).alias("season"))
    return tidy(decompose.decompose(attach(panel, periods), "season"), 10)


@query
def decomposition_daily(spark, sf):
    return tidy(decompose.decompose(daily(spark, sf), 7), 2)


@query
def decomposition_frame(spark, sf):
    return tidy(decompose.decomposition_frame(monthly(spark, sf), 12), 4)


@query
def before_after(spark, sf):
    panel = hourly(spark, sf)
    return tidy(decompose.before_after_frame(panel, prep.treat_outliers(panel, "clip", 1.5)), 5)


@query
def rolling_trend(spark, sf):
    return tidy(prep.rolling_mean(daily(spark, sf), 7, out="trend"), 2)


@query
def calendar_profile(spark, sf):
    panel = stored(spark, sf, mixed)
    return tidy(decompose.calendar_profile(panel, frequencies_of(spark, sf, mixed)), 3)


@query
def stat_cards(spark, sf):
    return tidy(evidence.cards(plain_features(spark, sf)))


@query
def evidence_trend(spark, sf):
    return tidy(evidence.trend_evidence(profile.trend_line(stored(spark, sf, mixed))))


@query
def evidence_seasonality(spark, sf):
    parts = decompose.decompose(monthly(spark, sf), 12)
    return tidy(evidence.seasonality_evidence(decompose.component_variances(parts)))


@query
def evidence_stationarity(spark, sf):
    panel = stored(spark, sf, mixed)
    return tidy(evidence.stationarity_evidence(stationarity.adf(panel, 0), stationarity.kpss(panel)))


@query
def evidence_autocorrelation(spark, sf):
    return tidy(evidence.autocorrelation_evidence(autocorr.correlogram(stored(spark, sf, mixed))))


@query
def pattern_summary(spark, sf):
    return tidy(evidence.pattern_summary(plain_features(spark, sf)))


# ---------------------------------------------------------------- recommendation


def _rules(task):
    def run(spark, sf):
        rows = recommend.recommendation_rows(recommend.recommend(plain_features(spark, sf), task))
        return tidy(joined_texts(rows, "reasons", "pros", "cons"), 4)

    return run


for _name, _task in zip(("forecasting", "classification", "anomaly", "clustering"), recommend.TASKS):
    CATALOG[f"rules_{_name}"] = _rules(_task)


@query
def rules_all_tasks(spark, sf):
    rows = recommend.recommend(plain_features(spark, sf), [*recommend.TASKS, "Unknown"])
    return tidy(rows.select(KEY, "task", F.col("primary.name").alias("primary_name"), F.size("alternatives").alias("n_alternatives")))


@query
def hybrid_suggestion(spark, sf):
    rows = recommend.recommend(plain_features(spark, sf))
    return tidy(rows.select(KEY, "hybrid_suggestion.*"))


def _assumed_picks(features):
    """A stand-in classifier whose pick and confidence follow from the profile."""
    pick = F.when(F.col("dataset_size") > 1000, "XGBoost").when(F.col("has_trend"), "ARIMA").otherwise("ETS")
    share = F.col("dataset_size") % 100 / 100
    return features.select(KEY, pick.alias("ai_name"), share.alias("ai_confidence"))


def _decisions(spark, sf):
    features = plain_features(spark, sf)
    return recommend.decide(recommend.recommend(features), _assumed_picks(features))


@query
def hybrid_decision(spark, sf):
    rows = _decisions(spark, sf).select(
        KEY, "ai_name", "ai_confidence", "rule_name", "rule_confidence", "final_name", "final_confidence", "reasoning"
    )
    return tidy(joined_texts(rows, "reasoning"), 5)


@query
def final_details(spark, sf):
    rows = recommend.final_details(_decisions(spark, sf))
    others = F.array_join(F.transform("other_options", lambda x: x["name"]), "; ")
    return rows.select(KEY, "final_name", F.col("details.category").alias("category"), others.alias("other_names"))


@query
def decision_comparison(spark, sf):
    return recommend.comparison(_decisions(spark, sf)).drop("task")


@query
def meta_inputs(spark, sf):
    rows = meta.meta_features(plain_features(spark, sf))
    names = ["length", "cv", "range", "seasonal_strength", "adf_pvalue", "autocorr_lag1", "pacf_lag1", "diff_needed", "zero_crossing_rate"]
    return tidy(rows.select(KEY, *names), 5, range=2)


@query
def parameter_hints(spark, sf):
    return tidy(recommend.parameter_hints(plain_features(spark, sf)))


# ---------------------------------------------------------------- forecasting

def _split(spark, sf):
    return split(hourly(spark, sf), 0.8)


@query
def holdout_split(spark, sf):
    return tidy(_split(spark, sf).drop("season"), 5)


def _naive(spark, sf):
    parts = _split(spark, sf)
    made = naive.predict(naive.fit(train_rows(parts), 24), holdout_rows(parts))
    other = naive.predict(naive.fit(train_rows(parts), 1), holdout_rows(parts))
    y = holdout_rows(parts).select(KEY, "i", "y")
    both = made.withColumn("model", F.lit("Seasonal Naive")).unionByName(other.withColumn("model", F.lit("Last Value")))
    return both.join(y, [KEY, "i"])


@query
def naive_forecast(spark, sf):
    return tidy(_naive(spark, sf).select(KEY, "model", "ts", "h", "y", "yhat"), 5)


@query
def forecast_metrics(spark, sf):
    return tidy(metrics(_naive(spark, sf)), 5)


@query
def model_ranking(spark, sf):
    return tidy(rank_models(metrics(_naive(spark, sf))).select(KEY, "model", "mae", "rank", "is_best"), 5)


@query
def metrics_chart(spark, sf):
    return tidy(metrics_frame(rank_models(metrics(_naive(spark, sf)))), 5)


@query
def seasonal_difference(spark, sf):
    """Root of the zero-lag sum of the doubly differenced training series behind the seasonal model."""
    train = train_rows(split(stored(spark, sf, mixed), 0.8))
    sums = arima.lag_sums(train, seasonal=True)
    return tidy(sums.select(KEY, F.sqrt(F.get("vec", F.lit(0))).alias("root_sum")), 3)


@query
def lag_frame(spark, sf):
    rows = boosted.lag_frame(_split(spark, sf))
    return tidy(rows.select(KEY, "ts", "y", *[f"lag_{k}" for k in boosted.DEFAULT_LAGS], "is_train"), 5)


def _own_lags(spark, sf):
    return shared(spark, sf, "own_lags", lambda: autocorr.lag_features(autocorr.correlogram(stored(spark, sf, mixed))))


@query
def lag_slots(spark, sf):
    """Slots filled from each series' own recommended lags."""
    rows = slots.slot_frame(split(stored(spark, sf, mixed), 0.8), _own_lags(spark, sf))
    return tidy(rows.select(KEY, "ts", "y", *slots.NAMES, "is_train"), 4)


def _bench(spark, sf):
    panel = stored(spark, sf, mixed)
    features = profile.seasonality_features(panel, frequencies_of(spark, sf, mixed))
    return Bench(panel, 0.8, features)


def _single(model):
    def run(spark, sf):
        rows = _bench(spark, sf).run(model).forecasts
        return tidy(rows.select(KEY, "model", "ts", "h", "y", "yhat"), 3)

    return run


for _name, _model in zip(
    ("sarima", "arima", "additive", "smoothing", "boosted", "seasonal_smoothing", "averaged_boosted"),
    ALL,
):
    CATALOG[f"forecast_{_name}"] = _single(_model)


@query
def forecast_smoothing_fixed(spark, sf):
    """Smoothing with one set of rates, composed from blocks of 20 months."""
    parts = split(monthly(spark, sf), 0.8)
    params = ets.fit(train_rows(parts), rates=[(0.3, 0.1, 0.2)], size=20)
    made = ets.predict(params, holdout_rows(parts)).join(params.select(KEY, "sse"), KEY)
    return tidy(made.select(KEY, "ts", "h", "yhat", F.sqrt("sse").alias("root_sse")), 3)


@query
def benchmark_fast(spark, sf):
    return tidy(compare(_bench(spark, sf), FAST).scores, 4)


@query
def benchmark_all(spark, sf):
    return tidy(compare(_bench(spark, sf), ALL).scores, 4)


@query
def benchmark_failed(spark, sf):
    """Status of models that cannot be fitted: the monthly series cut to too few rows for a season of 52."""
    seasons = lengths(monthly(spark, sf)).select(KEY, F.lit(52).alias("seasonal_period"))
    bench = Bench(monthly(spark, sf), 0.8, seasons)
    return compare(bench, ["SARIMA", "Exponential Smoothing", "STL + ETS (Hybrid)", "Prophet"]).failed


@query
def forecast_vs_actual(spark, sf):
    bench = _bench(spark, sf)
    result = compare(bench, ["ARIMA", "Exponential Smoothing", "XGBoost"])
    return tidy(forecast_frame(bench, result.forecasts), 3)


@query
def naive_vs_actual(spark, sf):
    bench = Bench(hourly(spark, sf), 0.8, lengths(hourly(spark, sf)).select(KEY, F.lit(24).alias("seasonal_period")))
    return tidy(forecast_frame(bench, bench.run("Seasonal Naive").forecasts), 5)


@query
def saved_model_score(spark, sf):
    """Save fitted parameters, load them, and score them on the rows after training."""
    import uuid

    bench = _bench(spark, sf)
    root = f"{workspace(spark)}/models-{uuid.uuid4().hex}"
    models.save_model(bench.params("Exponential Smoothing"), root, "Exponential Smoothing")
    loaded = models.load_model(spark, root, "exponential_smoothing")
    new = bench.future.select(KEY, "ts", (F.col("h") - 1).alias("i"), "y")
    ends = bench.train.groupBy(KEY).agg(F.max("n_train").alias("n_train"))
    return tidy(models.score_saved(loaded, "exponential_smoothing", new, ends), 3)


@query
def forecast_own_lags(spark, sf):
    """Boosted trees on each series' own lags, one step ahead."""
    run = Bench(stored(spark, sf, mixed), 0.8, lags=_own_lags(spark, sf)).run("XGBoost")
    return tidy(run.forecasts.select(KEY, "model", "ts", "h", "y", "yhat"), 3)


@query
def saved_trees_score(spark, sf):
    """Save boosted trees, load them, and run them ahead over the rows after training."""
    import uuid

    bench = Bench(stored(spark, sf, mixed), 0.8, lags=_own_lags(spark, sf))
    root = f"{workspace(spark)}/models-{uuid.uuid4().hex}"
    models.save_model(bench.run("XGBoost").params["XGBoost"], root, "XGBoost")
    loaded = models.load_model(spark, root, "xgboost")
    ends = written(loaded.params.where("status = 'success'").select(KEY, "n_train"), "ends")
    future = attach(bench.parts.select(KEY, "ts", "i", "y"), ends).where("i >= n_train")
    return tidy(models.score_saved(loaded, "xgboost", future.select(KEY, "ts", (F.col("i") - F.col("n_train")).alias("i"), "y"), ends), 3)


@query
def next_30(spark, sf):
    """Thirty periods beyond the end of every series."""
    panel = stored(spark, sf, mixed)
    whole = split(panel, 1.0)
    ends = whole.groupBy(KEY).agg(F.max("n_train").alias("n_train"), F.max("ts").alias("last_ts"))
    gaps = frequencies_of(spark, sf, mixed).select(KEY, F.col("median_gap_seconds").alias("gap_seconds"))
    return tidy(models.next_steps(arima.fit(whole), "ARIMA", ends.join(gaps, KEY), 30), 3)


def _learned(spark, sf):
    """Features and training rows of the classifier, written once per session and scale."""
    panel = shared(spark, sf, "learned_panel", lambda: _training_panel(spark, sf))
    frequencies = shared(spark, sf, "learned_freq", lambda: quality.detect_frequency(panel))
    features = shared(spark, sf, "learned_features", lambda: profile.profile(panel, frequencies))
    return features, shared(spark, sf, "learned_rows", lambda: _training_rows(features, panel))


def _training_panel(spark, sf):
    """Monthly sales per brand, supplier and part type: the classifier's training series."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    # names kept as codes in a file take many times its bytes in memory, so Spark would broadcast millions of parts
    lines = table(spark, sf, "lineitem").join(parts.hint("merge"), "l_partkey")
    kinds = {"brand": F.col("p_brand"), "supplier": F.col("l_suppkey").cast("string"), "type": F.col("p_type")}
    named = F.explode(F.array(*[F.concat(F.lit(f"{kind} "), name) for kind, name in kinds.items()])).alias("name")
    return build_panel(lines.select("l_shipdate", "l_quantity", named), "name", "l_shipdate", "l_quantity", "month")


def _training_rows(features, panel):
    return meta.training_set(features, compare(Bench(panel, 0.8, features), ALL).scores)


@query
def meta_training_set(spark, sf):
    return tidy(_learned(spark, sf)[1], 4)


@query
def meta_prediction(spark, sf):
    features, training = _learned(spark, sf)
    return tidy(meta.predict(meta.train(training), features), 5)


@query
def meta_top_three(spark, sf):
    features, training = _learned(spark, sf)
    return tidy(meta.predict_top_k(meta.train(training), features, 3), 5)


@query
def meta_accuracy(spark, sf):
    """Share of right labels on held-out and on learned series, beside that of the most frequent label."""
    return tidy(meta.accuracy(written(meta.held_out(_learned(spark, sf)[1]), "held-out")), 4)


@query
def meta_importances(spark, sf):
    _, training = _learned(spark, sf)
    return tidy(meta.train(training).importances(spark), 6)


@query
def analysis_flow(spark, sf):
    """Validate, preprocess and profile in one go, then recommend."""
    done = analyze(gappy(spark, sf))
    rows = recommend.recommend(done.features)
    return tidy(rows.select(KEY, F.col("primary.name").alias("primary_name"), F.col("primary.confidence").alias("confidence")))


# ---------------------------------------------------------------- other tasks


@query
def anomalies_residual(spark, sf):
    return tidy(anomalies.residual_anomalies(daily(spark, sf), 7), 2, z=6)


@query
def isolation_inputs(spark, sf):
    return tidy(anomalies.isolation_features(hourly(spark, sf)), 5)


@query
def anomalies_isolation(spark, sf):
    return tidy(anomalies.isolation_forest(hourly(spark, sf)), 6)


@query
def anomalies_reconstruction(spark, sf):
    return tidy(anomalies.over_threshold(anomalies.reconstruction_errors(hourly(spark, sf))), 6)


@query
def error_threshold(spark, sf):
    """The threshold rule alone, on squared deviations from the series mean."""
    panel = hourly(spark, sf)
    means = panel.groupBy(KEY).agg(F.avg("y").alias("m"))
    errors = panel.join(means, KEY).select(KEY, "ts", "i", ((F.col("y") - F.col("m")) ** 2).alias("mse"))
    return tidy(anomalies.over_threshold(errors), 4)


@query
def classify_forest(spark, sf):
    """Forest on profile features, trained on 80 % of the series; report on the rest."""
    panel = stored(spark, sf, vectors)
    frequencies = lengths(panel).select(KEY, F.lit("D").alias("frequency"))
    features = profile.profile(panel, frequencies)
    rows = written(classify.mark_test(meta.meta_features(features).join(vector_labels(spark, sf), KEY)), "labelled")
    forest = classify.ForestClassifier(meta.TOP_FEATURES).fit(rows.where("not is_test"))
    return tidy(classify.report(forest.predict(rows.where("is_test"))), 5)


@query
def classification_report(spark, sf):
    """The report alone, with one label column standing for the truth and one for the guess."""
    return tidy(classify.report(table(spark, sf, "labels"), "quality", "toxic"), 6)


@query
def classify_neighbours(spark, sf):
    rows = classify.knn_dtw(sequences.series_arrays(vectors(spark, sf)), vector_labels(spark, sf))
    return tidy(rows)


@query
def cluster_kmeans(spark, sf):
    return tidy(cluster.kmeans_dtw(sequences.series_arrays(vectors(spark, sf))), 4)


@query
def cluster_hierarchical(spark, sf):
    panel = vectors(spark, sf)
    features = profile.moment_features(panel).join(profile.change_features(panel), KEY)
    names = ["mean", "std", "skewness", "kurtosis", "mean_abs_change", "zero_crossing_rate"]
    return tidy(cluster.cluster_sizes(cluster.hierarchical(features, names)))


def _customers(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.avg("o_totalprice").alias("mean_price"), F.count("*").cast("double").alias("n_orders")
    )
    return cluster.standardise(rows, ["mean_price", "n_orders"])


@query
def cluster_density(spark, sf):
    return tidy(cluster.dbscan(_customers(spark, sf), 2, eps=0.2))


@query
def cluster_density_sizes(spark, sf):
    return tidy(cluster.cluster_sizes(cluster.dbscan(_customers(spark, sf), 2, eps=0.2)))


@query
def calendar_columns(spark, sf):
    return tidy(sequences.calendar_features(daily(spark, sf)), 2)


@query
def sliding_sequences(spark, sf):
    rows = sequences.sequences(monthly(spark, sf), 30)
    text = F.array_join(F.transform("inputs", lambda v: v.cast("long").cast("string")), ",")
    return tidy(rows.withColumn("inputs", text), 2)


@query
def first_labels(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias(KEY), F.unix_micros(F.col("ts").cast("timestamp")).alias("i"), "event_type"
    )
    return sequences.series_labels(rows, "event_type")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Profile every daily order series and recommend a forecaster."""
    panel = written(daily(spark, sf), "daily")
    features = written(profile.profile(panel, quality.detect_frequency(panel)), "features")
    best = recommend.recommend(features).select(KEY, F.col("primary.name").alias("primary_name"))
    return features.join(best, KEY, "left").select(
        KEY, "dataset_size", "frequency", "mean", "std", "trend_slope", "trend_direction", "has_trend",
        "has_seasonality", "is_stationary", "data_complexity_score", "primary_name",
    )
