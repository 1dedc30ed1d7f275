"""The catalog's queries as plain SQL over the same tables, for checking results elsewhere."""

from __future__ import annotations

from seriesloom.operators.recommend import FORECASTING_TEXT, HYBRID_TEXT, OTHER_TEXT

PERIODS = {"H": 24, "D": 7, "W": 52, "M": 12, "Q": 4}


def r(expr: str, digits: int, name: str | None = None) -> str:
    return f"round({expr}, {digits}) + 0.0" + (f" AS {name}" if name else "")


def fold(table: str, key: str, ts: str, value: str, unit: str, how: str = "sum") -> str:
    return (
        f"SELECT {key} AS series_id, CAST(date_trunc('{unit}', {ts}) AS TIMESTAMP) AS ts, "
        f"{how}({value}) AS y FROM {table} GROUP BY 1, 2"
    )


DAILY_ROWS = fold("orders", "o_orderpriority", "o_orderdate", "o_totalprice", "day")
MONTHLY_ROWS = fold("lineitem", "l_returnflag", "l_shipdate", "l_quantity", "month")
HOURLY_ROWS = fold("events", "event_type", "ts", "value", "hour", "avg")
INDEX = "row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i"


def panel(rows: str) -> str:
    return f"folded AS ({rows}), panel AS (SELECT series_id, ts, {INDEX}, y FROM folded)"


DAILY, MONTHLY, HOURLY = panel(DAILY_ROWS), panel(MONTHLY_ROWS), panel(HOURLY_ROWS)
MIXED = panel(f"{DAILY_ROWS} UNION ALL {MONTHLY_ROWS} UNION ALL {HOURLY_ROWS}")
GAPPY = f"""folded AS ({HOURLY_ROWS}),
spans AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM folded GROUP BY 1),
grid AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM spans),
panel AS (SELECT series_id, ts, {INDEX}, y FROM grid LEFT JOIN folded USING (series_id, ts))"""

W = "(PARTITION BY series_id ORDER BY i)"
UPTO = "(PARTITION BY series_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
FROM_ = "(PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
ALL_ = "(PARTITION BY series_id)"
PREV = f"last_value(y IGNORE NULLS) OVER {UPTO}"
NEXT = f"first_value(y IGNORE NULLS) OVER {FROM_}"


def rows(lo: str, hi: str) -> str:
    return f"(PARTITION BY series_id ORDER BY i ROWS BETWEEN {lo} AND {hi})"


def sql(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {select}"


FREQ = f"""gaps AS (SELECT series_id, date_diff('microsecond', lag(ts) OVER {W}, ts) / 1e6 AS gap FROM panel),
freq AS (SELECT series_id, quantile_cont(gap, 0.5) AS median_gap FROM gaps GROUP BY 1),
freqs AS (SELECT series_id, median_gap,
  CASE WHEN median_gap <= 3600 THEN 'H' WHEN median_gap <= 86400 THEN 'D' WHEN median_gap <= 604800 THEN 'W'
       WHEN median_gap <= 2678400 THEN 'M' WHEN median_gap <= 7948800 THEN 'Q' ELSE 'Y' END AS frequency FROM freq),
periods AS (SELECT series_id, frequency, CASE frequency WHEN 'H' THEN 24 WHEN 'D' THEN 7 WHEN 'W' THEN 52
  WHEN 'M' THEN 12 WHEN 'Q' THEN 4 ELSE 1 END AS period FROM freqs)"""


def decomposed(name: str, source: str, p: int) -> str:
    """CTEs ending in ``name`` with trend, seasonal and resid for period p."""
    h = p // 2
    wide = rows(f"{h} PRECEDING", f"{h} FOLLOWING")
    if p % 2:
        mean = f"sum(y) OVER {wide} / {p}"
    else:
        inner = rows(f"{h - 1} PRECEDING", f"{h - 1} FOLLOWING")
        mean = f"(sum(y) OVER {wide} + sum(y) OVER {inner}) / {2 * p}"
    front = f"i >= {h} AND i < least({h + p}, n - 1 - {h})"
    back = f"i >= greatest({h}, n - 1 - {h} - {p}) AND i < n - 1 - {h}"
    return f"""{name}_a AS (SELECT series_id, ts, i, y, count(*) OVER {ALL_} AS n,
  CASE WHEN count(y) OVER {wide} = {2 * h + 1} THEN {mean} END AS ma FROM {source}),
{name}_b AS (SELECT series_id,
  regr_slope(ma, i) FILTER (WHERE {front}) AS fk, regr_intercept(ma, i) FILTER (WHERE {front}) AS fc,
  regr_slope(ma, i) FILTER (WHERE {back}) AS bk, regr_intercept(ma, i) FILTER (WHERE {back}) AS bc
  FROM {name}_a GROUP BY 1),
{name}_c AS (SELECT a.*, CASE WHEN i < {h} THEN fc + fk * i WHEN i > n - 1 - {h} THEN bc + bk * i ELSE ma END AS trend
  FROM {name}_a a JOIN {name}_b USING (series_id) WHERE n >= {2 * p}),
{name}_d AS (SELECT series_id, i % {p} AS phase, avg(y - trend) AS raw FROM {name}_c GROUP BY 1, 2),
{name}_e AS (SELECT series_id, phase, raw - avg(raw) OVER {ALL_} AS seasonal FROM {name}_d),
{name} AS (SELECT c.series_id, c.ts, c.i, c.y, {p} AS period, c.trend, e.seasonal, c.y - c.trend - e.seasonal AS resid
  FROM {name}_c c JOIN {name}_e e ON c.series_id = e.series_id AND c.i % {p} = e.phase)"""


def by_frequency() -> str:
    """CTE ``season_parts``: decomposition of every series with the period of its frequency."""
    parts = [
        decomposed(f"d_{code}", f"(SELECT panel.* FROM panel JOIN periods USING (series_id) WHERE frequency = '{code}')", p)
        for code, p in PERIODS.items()
    ]
    union = " UNION ALL ".join(f"SELECT * FROM d_{code}" for code in PERIODS)
    return ",\n".join(parts) + f",\nseason_parts AS ({union})"


STATS = f"""means AS (SELECT series_id, avg(y) AS m, stddev_pop(y) AS sp, count(y) AS n FROM panel GROUP BY 1),
centred AS (SELECT panel.series_id, i, y, y - m AS c, n FROM panel JOIN means USING (series_id)),
covs AS (SELECT a.series_id, a.n, k, sum(a.c * b.c) AS cov FROM centred a
  CROSS JOIN generate_series(0, 40) g(k) JOIN centred b ON b.series_id = a.series_id AND b.i = a.i - k GROUP BY 1, 2, 3),
acfs AS (SELECT series_id, n, k, cov, cov / first_value(cov) OVER (PARTITION BY series_id ORDER BY k) AS acf,
  1.96 / sqrt(n) AS band FROM covs)"""

PACF = """scaled AS (SELECT series_id, n, k, (cov / (n - k)) / (first_value(cov) OVER (PARTITION BY series_id ORDER BY k) / n) AS rho
  FROM covs WHERE k <= least(40, n // 2 - 1)),
rhos AS (SELECT series_id, list(rho ORDER BY k) FILTER (WHERE k > 0) AS rho, max(k) AS top FROM scaled GROUP BY 1),
steps AS (SELECT series_id, rho, top, 1 AS k, [rho[1]] AS phi, rho[1] AS last FROM rhos
  UNION ALL
  SELECT series_id, rho, top, k + 1,
    list_append(list_transform(range(1, k + 1), lambda j: phi[j] - fresh * phi[k + 1 - j]), fresh), fresh
  FROM (SELECT *, (rho[k + 1] - list_dot_product(phi, list_reverse(rho[1:k]))) / (1 - list_dot_product(phi, rho[1:k])) AS fresh
    FROM steps WHERE k < top)),
pacfs AS (SELECT series_id, k, last AS pacf FROM steps UNION ALL SELECT series_id, 0, 1.0 FROM rhos)"""

LAGS = """sig AS (SELECT series_id, list(k ORDER BY k) FILTER (WHERE k > 0 AND abs(acf) > band AND k <= n // 2) AS lags,
  max(acf) FILTER (WHERE k = 1) AS lag_1_acf, max(abs(acf)) FILTER (WHERE k > 0 AND k <= n // 2) AS top FROM acfs GROUP BY 1),
tops AS (SELECT a.series_id, min(k) AS max_acf_lag FROM acfs a JOIN sig USING (series_id)
  WHERE k > 0 AND k <= n // 2 AND abs(acf) = top GROUP BY 1),
psig AS (SELECT p.series_id, min(k) FILTER (WHERE k > 0 AND abs(pacf) > 1.96 / sqrt(n)) AS pacf_order
  FROM pacfs p JOIN means USING (series_id) GROUP BY 1),
lagf AS (SELECT s.series_id, lag_1_acf, coalesce(pacf_order, 0) AS pacf_order,
  CASE WHEN lags IS NULL OR len(lags) = 0 THEN [1] ELSE lags[1:5] END AS rec, max_acf_lag
  FROM sig s JOIN tops USING (series_id) JOIN psig USING (series_id))"""
REC_TEXT = "'[' || array_to_string(rec, ', ') || ']'"

# two-sided Student tail by Simpson's rule on the angle form of the density
LINE = """fit AS (SELECT series_id, regr_count(y, i) AS points, regr_slope(y, i) AS slope, regr_intercept(y, i) AS intercept,
  corr(y, i) AS r FROM panel GROUP BY 1),
tvals AS (SELECT *, r * sqrt(points - 2) / sqrt(1 - r * r) AS t, points - 2 AS dof FROM fit),
tails AS (SELECT series_id, sum(w * pow(cos(lo + (pi() / 2 - lo) * s / 4000), dof - 1)) * (pi() / 2 - lo) / 12000
    * 2 * exp(lgamma((dof + 1) / 2.0) - lgamma(dof / 2.0)) / sqrt(pi()) AS p_value
  FROM (SELECT series_id, dof, atan(abs(t) / sqrt(dof)) AS lo FROM tvals),
       (SELECT s, CASE WHEN s IN (0, 4000) THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END AS w FROM generate_series(0, 4000) g(s))
  GROUP BY series_id, dof, lo),
line AS (SELECT tvals.*, p_value FROM tvals JOIN tails USING (series_id))"""

# plain Dickey-Fuller regression in closed form; the normal distribution by Simpson's rule
ROOT = f"""steps_df AS (SELECT series_id, y - lag(y) OVER {W} AS dy, lag(y) OVER {W} AS x FROM panel),
reg AS (SELECT series_id, regr_slope(dy, x) AS b, regr_sxx(dy, x) AS sxx, regr_syy(dy, x) AS syy, regr_count(dy, x) AS m
  FROM steps_df GROUP BY 1),
taus AS (SELECT series_id, b / sqrt((syy - b * b * sxx) / (m - 2) / sxx) AS tau FROM reg),
zs AS (SELECT series_id, tau, CASE WHEN tau <= -1.61 THEN 2.1659 + 1.4412 * tau + 0.038269 * tau * tau
  ELSE 1.7339 + 0.93202 * tau - 0.12745 * tau * tau - 0.010368 * tau * tau * tau END AS z FROM taus),
phis AS (SELECT series_id, tau, 0.5 + z / 12000 / sqrt(2 * pi()) * sum(w * exp(-0.5 * pow(z * s / 4000, 2))) AS phi FROM zs,
  (SELECT s, CASE WHEN s IN (0, 4000) THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END AS w FROM generate_series(0, 4000) g(s))
  GROUP BY series_id, tau, z),
root AS (SELECT series_id, tau AS adf_statistic, greatest(CASE WHEN tau > 2.74 THEN 1.0 WHEN tau < -18.83 THEN 0.0 ELSE phi END, 0.0)
  AS adf_p_value FROM phis)"""

KPSS = """sums AS (SELECT series_id, i, c, n, sum(c) OVER (PARTITION BY series_id ORDER BY i) AS s FROM centred),
prods AS (SELECT a.series_id, a.n, k, sum(a.c * b.c) AS p FROM centred a CROSS JOIN generate_series(0, 120) g(k)
  JOIN centred b ON b.series_id = a.series_id AND b.i = a.i - k GROUP BY 1, 2, 3),
ratio AS (SELECT series_id, n, sum(CASE WHEN k = 0 THEN 0 ELSE 2 * k * p END) / sum(CASE WHEN k = 0 THEN p ELSE 2 * p END) AS q
  FROM prods WHERE k <= floor(pow(n, 2.0 / 9.0)) GROUP BY 1, 2),
widths AS (SELECT series_id, n, CAST(least(floor(1.1447 * cbrt(q * q) * cbrt(n)), n - 1) AS BIGINT) AS lag FROM ratio),
vars AS (SELECT p.series_id, p.n, lag, sum(CASE WHEN k = 0 THEN p ELSE 2 * p * (1 - k / (lag + 1.0)) END) / p.n AS v
  FROM prods p JOIN widths USING (series_id) WHERE k <= lag GROUP BY 1, 2, 3),
stat AS (SELECT v.series_id, lag, sum(s * s) / pow(v.n, 2) / v AS eta FROM vars v JOIN sums USING (series_id)
  GROUP BY v.series_id, v.n, lag, v),
level AS (SELECT series_id, lag AS kpss_lag, eta AS kpss_statistic,
  CASE WHEN eta <= 0.347 THEN 0.1 WHEN eta <= 0.463 THEN 0.1 - 0.05 * (eta - 0.347) / 0.116
       WHEN eta <= 0.574 THEN 0.05 - 0.025 * (eta - 0.463) / 0.111 WHEN eta <= 0.739 THEN 0.025 - 0.015 * (eta - 0.574) / 0.165
       ELSE 0.01 END AS kpss_p_value FROM stat)"""

MOMENTS = """bounds AS (SELECT series_id, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3, quantile_cont(y, 0.5) AS median
  FROM panel GROUP BY 1),
outs AS (SELECT series_id, count(*) FILTER (WHERE y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)) AS outliers_count,
  count(*) AS total FROM panel JOIN bounds USING (series_id) GROUP BY 1),
devs AS (SELECT series_id, avg(pow(c, 2)) AS m2, avg(pow(c, 3)) AS m3, avg(pow(c, 4)) AS m4 FROM centred GROUP BY 1),
momf AS (SELECT p.series_id, avg(y) AS mean, stddev_samp(y) AS std, min(y) AS min, max(y) AS max,
  any_value(m3 / pow(m2, 1.5)) AS skewness, any_value(m4 / pow(m2, 2) - 3) AS kurtosis,
  CASE WHEN avg(y) = 0 THEN 0 ELSE stddev_samp(y) / avg(y) END AS cv, any_value(median) AS median,
  any_value(outliers_count) AS outliers_count, any_value(outliers_count * 100.0 / total) AS outlier_pct
  FROM panel p JOIN devs USING (series_id) JOIN bounds USING (series_id) JOIN outs USING (series_id) GROUP BY 1)"""

BASIC = """basic AS (SELECT series_id, count(y) AS dataset_size,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS date_range,
  count(*) FILTER (WHERE y IS NULL) * 100.0 / count(*) AS missing_pct FROM panel GROUP BY 1)"""

TREND = """flags AS (SELECT series_id, abs(slope) > 0.01 AND p_value < 0.05 AS has_trend,
  CASE WHEN slope > 0 THEN 'upward' WHEN slope < 0 THEN 'downward' ELSE 'none' END AS trend_direction,
  slope AS trend_slope, r * r AS trend_linearity FROM line)"""
TREND12 = (
    decomposed("d12", "panel", 12)
    + """,
v12 AS (SELECT series_id, var_samp(trend) AS tv, var_samp(resid) AS rv FROM d12 GROUP BY 1),
tstr AS (SELECT line.series_id, CASE WHEN tv + rv > 0 THEN greatest(0, 1 - rv / (tv + rv)) ELSE abs(r) END AS trend_strength
  FROM line LEFT JOIN v12 USING (series_id))"""
)
SEASON = (
    by_frequency()
    + """,
svar AS (SELECT series_id, var_samp(seasonal) AS sv, var_samp(resid) AS rv FROM season_parts GROUP BY 1),
seas AS (SELECT periods.series_id, period, coalesce(CASE WHEN sv + rv > 0 THEN greatest(0, 1 - rv / (sv + rv)) END, 0) AS share
  FROM periods LEFT JOIN svar USING (series_id))"""
)
CHANGES = f"""moves AS (SELECT series_id, y - lag(y) OVER {W} AS d, sign(c) <> lag(sign(c)) OVER {W} AS crossed FROM centred),
chg AS (SELECT series_id, avg(abs(d)) AS mean_abs_change, stddev_pop(d) AS std_1st_diff,
  count(*) FILTER (WHERE crossed) * 1.0 / count(*) AS zero_crossing_rate FROM moves GROUP BY 1)"""

FEATURES = ",\n".join([MIXED, FREQ, STATS, PACF, LAGS, LINE, ROOT, MOMENTS, BASIC, TREND, TREND12, SEASON, CHANGES]) + """,
joined AS (SELECT b.series_id, dataset_size, date_range, missing_pct, true AS univariate, frequency,
  mean, std, min, max, skewness, kurtosis, cv, median, outliers_count, outlier_pct,
  has_trend, trend_direction, trend_slope, trend_linearity, trend_strength,
  share > 0.3 AS has_seasonality, CASE WHEN share > 0.3 THEN period END AS seasonal_period, share AS seasonality_strength,
  adf_statistic, adf_p_value, adf_p_value < 0.05 AS is_stationary,
  lag_1_acf, pacf_order, rec, max_acf_lag, mean_abs_change, std_1st_diff, zero_crossing_rate
  FROM basic b JOIN periods USING (series_id) JOIN momf USING (series_id) JOIN flags USING (series_id)
  JOIN tstr USING (series_id) JOIN seas USING (series_id) JOIN root USING (series_id) JOIN lagf USING (series_id)
  JOIN chg USING (series_id)),
features AS (SELECT *, least(10, CASE WHEN has_trend THEN 2 ELSE 0 END + CASE WHEN has_seasonality THEN 2 ELSE 0 END
  + CASE WHEN is_stationary THEN 0 ELSE 1 END + CASE WHEN outlier_pct > 5 THEN 1 ELSE 0 END
  + CASE WHEN dataset_size > 1000 THEN 2 ELSE 0 END + CASE WHEN lag_1_acf > 0.7 THEN 1 ELSE 0 END
  + CASE WHEN seasonality_strength > 0.6 THEN 1 ELSE 0 END) AS score FROM joined)"""
FEATURES = FEATURES.replace("seas USING (series_id)", "(SELECT series_id, period AS seas_period, share FROM seas) USING (series_id)")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


REASON_VALUES = {
    "seasonal_period": "seasonal_period",
    "seasonality_strength": "seasonality_strength",
    "non_stationary_text": "CASE WHEN is_stationary THEN 'False' ELSE 'True' END",
    "dataset_size": "dataset_size",
    "data_complexity_score": "score",
    "lags_text": "'[' || array_to_string(rec[1:3], ', ') || ']'",
    "lag_1_acf": "lag_1_acf",
}


def rule(order: int, name: str, condition: str, confidence: str) -> str:
    category, reasons, pros, cons = {**FORECASTING_TEXT, **OTHER_TEXT}[name]
    texts = [quoted(t) if isinstance(t, str) else f"printf({quoted(t[0])}, {REASON_VALUES[t[1]]})" for t in reasons]
    return (
        f"SELECT series_id, {order} AS pos, {quoted(name)} AS name, CAST({confidence} AS DOUBLE) AS confidence, "
        f"{quoted(category)} AS category, concat_ws('; ', {', '.join(texts)}) AS reasons, "
        f"{quoted('; '.join(pros))} AS pros, {quoted('; '.join(cons))} AS cons FROM features WHERE {condition}"
    )


FORECAST_RULES = [
    ("SARIMA", "has_seasonality AND NOT is_stationary AND dataset_size < 5000", "least(95, 90 + 10 * seasonality_strength)"),
    ("Prophet", "has_seasonality AND dataset_size >= 100", "least(92, 80 + 15 * seasonality_strength)"),
    ("ARIMA", "has_trend AND NOT has_seasonality AND dataset_size < 3000", "85"),
    ("Exponential Smoothing (ETS)", "score < 5 AND dataset_size < 1000", "75"),
    ("XGBoost with Lag Features", "dataset_size > 1000 OR score >= 6", "least(92, 82 + 1.5 * least(score, 10))"),
    ("LSTM (Deep Learning)", "dataset_size > 5000 AND score >= 7", "least(88, 78 + 2 * score)"),
]
LISTED_RULES = {
    "Classification": [
        ("Random Forest Classifier", "true", "85"), ("LSTM Classifier", "dataset_size > 1000", "80"), ("k-NN with DTW", "true", "75"),
    ],
    "Anomaly Detection": [
        ("STL Decomposition + Z-Score", "has_seasonality", "88"), ("Isolation Forest", "true", "85"),
        ("LSTM Autoencoder", "dataset_size > 500", "82"),
    ],
    "Clustering": [
        ("K-Means with DTW Distance", "true", "82"), ("Hierarchical Clustering", "true", "78"), ("DBSCAN", "true", "75"),
    ],
}


def union_rules(rules) -> str:
    return " UNION ALL ".join(rule(k, *item) for k, item in enumerate(rules))


def ranked(task: str) -> str:
    rules = FORECAST_RULES if task == "Forecasting" else LISTED_RULES[task]
    order = "confidence DESC, pos" if task == "Forecasting" else "pos"
    top = "WHERE rank <= 3" if task == "Forecasting" else ""
    return (
        f"SELECT series_id, {quoted(task)} AS task, rank, name, {r('confidence', 4, 'confidence')}, category, reasons, pros, cons "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY {order}) AS rank FROM ({union_rules(rules)})) {top}"
    )


DECIDED = FEATURES + f""",
rules AS ({ranked('Forecasting')}),
firsts AS (SELECT series_id, name AS rule_name, confidence / 100 AS r FROM rules WHERE rank = 1),
picks AS (SELECT series_id, CASE WHEN dataset_size > 1000 THEN 'XGBoost' WHEN has_trend THEN 'ARIMA' ELSE 'ETS' END AS ai,
  (dataset_size % 100) / 100.0 AS a FROM features),
met AS (SELECT series_id, ai, a, rule_name, coalesce(r, 0) AS r, a > 0.3 AS ok,
  coalesce(ai = CASE rule_name WHEN 'Exponential Smoothing (ETS)' THEN 'ETS' WHEN 'XGBoost with Lag Features' THEN 'XGBoost'
    ELSE rule_name END, false) AS same FROM picks LEFT JOIN firsts USING (series_id)),
cases AS (SELECT *, CASE WHEN a >= 0.6 THEN CASE WHEN same THEN 'ha' ELSE 'h' END
  WHEN a >= 0.4 AND same THEN 'ma' WHEN a >= 0.4 AND 0.8 * a > 0.2 * r THEN 'm' WHEN a >= 0.4 THEN 'mr' ELSE 'r' END AS kind FROM met),
decided AS (SELECT *, CASE WHEN kind IN ('mr', 'r') THEN rule_name ELSE ai END AS final_name,
  CASE kind WHEN 'ha' THEN least(0.95, 0.8 * a + 0.2 * r + 0.1) WHEN 'h' THEN 0.8 * a + 0.2 * r WHEN 'ma' THEN 0.8 * a + 0.2 * r + 0.1
    WHEN 'm' THEN 0.8 * a WHEN 'mr' THEN 0.5 * a + 0.5 * r ELSE r END AS final_confidence FROM cases),
finals AS (SELECT *, CASE final_name WHEN 'Exponential Smoothing (ETS)' THEN 'ETS' WHEN 'XGBoost with Lag Features' THEN 'XGBoost'
    ELSE final_name END AS final_id FROM decided)"""

SPLIT = HOURLY + f""",
parts AS (SELECT *, count(*) OVER {ALL_} AS n, CAST(floor(count(*) OVER {ALL_} * 0.8) AS BIGINT) AS n_train FROM panel),
tests AS (SELECT *, i - n_train + 1 AS h FROM parts WHERE i >= n_train)"""
NAIVE = SPLIT + """,
made AS (SELECT t.series_id, 'Seasonal Naive' AS model, t.ts, t.h, t.y, p.y AS yhat FROM tests t
    JOIN parts p ON p.series_id = t.series_id AND p.i % 24 = t.i % 24 AND p.i >= t.n_train - 24 AND p.i < t.n_train
  UNION ALL SELECT t.series_id, 'Last Value', t.ts, t.h, t.y, p.y FROM tests t
    JOIN parts p ON p.series_id = t.series_id AND p.i = t.n_train - 1),
scored AS (SELECT series_id, model, count(*) AS points, avg(abs(y - yhat)) AS mae, sqrt(avg(pow(y - yhat, 2))) AS rmse,
  100 * avg(abs(y - yhat) / greatest(abs(y), 1e-8)) AS mape,
  CASE WHEN var_pop(y) > 0 THEN 1 - sum(pow(y - yhat, 2)) / (var_pop(y) * count(*)) WHEN sum(pow(y - yhat, 2)) = 0 THEN 1 ELSE 0 END AS r2
  FROM made GROUP BY 1, 2),
ranks AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mae, model) AS rank FROM scored)"""

SQL: dict[str, str] = {}

for _name, _ctes, _d in (("daily", DAILY, 2), ("monthly", MONTHLY, 2), ("hourly", HOURLY, 6)):
    SQL[f"panel_{_name}"] = sql(_ctes, f"SELECT series_id, ts, i, {r('y', _d, 'y')} FROM panel")
SQL["csv_round_trip"] = SQL["panel_monthly"]
SQL["preview_rows"] = f"SELECT event_id, ts, event_type, {r('value', 4, 'value')} FROM events ORDER BY ts LIMIT 10"
SQL["table_shape"] = "SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM events"
SQL["prepared_series"] = (
    "SELECT event_type AS series_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) - 1 AS i, "
    f"{r('value', 4, 'y')} FROM events"
)

SQL["frequency"] = sql(
    f"{MIXED}, {FREQ}",
    f"SELECT series_id, {r('median_gap', 3, 'median_gap_seconds')}, frequency, "
    "CASE frequency WHEN 'H' THEN 'Hourly' WHEN 'D' THEN 'Daily' WHEN 'W' THEN 'Weekly' WHEN 'M' THEN 'Monthly' "
    "WHEN 'Q' THEN 'Quarterly' ELSE 'Yearly' END AS frequency_name FROM freqs",
)
_CHECKS = """SELECT series_id, n, n_null, n_duplicate, concat_ws('; ',
  CASE WHEN n < 10 THEN 'Dataset too small (minimum 10 observations required)' END,
  CASE WHEN n_null * 100.0 / n > 50 THEN printf('Too many missing values in target column (%.1f%%)', n_null * 100.0 / n) END,
  CASE WHEN n_duplicate > 0 THEN 'Duplicate timestamps detected' END) AS errors,
  n >= 10 AND n_null * 100.0 / n <= 50 AND n_duplicate = 0 AS is_valid
FROM (SELECT {key} AS series_id, count(*) AS n, count(*) - count({y}) AS n_null, count(*) - count(DISTINCT {ts}) AS n_duplicate
  FROM {source} GROUP BY 1)"""
SQL["validation"] = sql(GAPPY, _CHECKS.format(key="series_id", y="y", ts="ts", source="panel"))
SQL["validation_raw"] = _CHECKS.format(key="o_orderpriority", y="o_totalprice", ts="o_orderdate", source="orders")
SQL["basic_stats"] = sql(
    GAPPY,
    'SELECT series_id, count(*) AS "count", count(*) - count(y) AS missing, '
    + r("(count(*) - count(y)) * 100.0 / count(*)", 5, "missing_pct") + ", " + r("avg(y)", 5, "mean") + ", "
    + r("stddev_samp(y)", 5, "std") + ", " + r("min(y)", 5, '"min"') + ", " + r("max(y)", 5, '"max"') + ", "
    + r("max(y) - min(y)", 5, '"range"') + ", " + r("quantile_cont(y, 0.5)", 5, "median") + " FROM panel GROUP BY 1",
)

_PICK = "SELECT series_id, ts, i, {} FROM panel"
SQL["fill_ffill"] = sql(GAPPY, _PICK.format(r(f"coalesce({PREV}, {NEXT})", 5, "y")))
SQL["fill_bfill"] = sql(GAPPY, _PICK.format(r(f"coalesce({NEXT}, {PREV})", 5, "y")))
SQL["fill_mean"] = sql(GAPPY, _PICK.format(r(f"coalesce(y, avg(y) OVER {ALL_})", 5, "y")))
SQL["fill_none"] = sql(GAPPY, _PICK.format(r("y", 5, "y")))
SQL["fill_drop"] = sql(GAPPY, f"SELECT series_id, ts, row_number() OVER {W} - 1 AS i, {r('y', 5, 'y')} FROM panel WHERE y IS NOT NULL")
_LINEAR = GAPPY + f""",
around AS (SELECT *, {PREV} AS y0, {NEXT} AS y1, max(CASE WHEN y IS NOT NULL THEN i END) OVER {UPTO} AS i0,
  min(CASE WHEN y IS NOT NULL THEN i END) OVER {FROM_} AS i1 FROM panel),
filled AS (SELECT series_id, ts, i, CASE WHEN y IS NOT NULL THEN y WHEN y0 IS NOT NULL AND y1 IS NOT NULL
  THEN y0 + (y1 - y0) * (i - i0) / (i1 - i0) ELSE coalesce(y0, y1) END AS y FROM around)"""
SQL["fill_interpolate"] = sql(_LINEAR, f"SELECT series_id, ts, i, {r('y', 5, 'y')} FROM filled")

_FENCES = "fences AS (SELECT series_id, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM {} GROUP BY 1)"
_CLIPPED = "greatest(least(y, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1))"
SQL["outliers_clip"] = sql(
    f"{HOURLY}, {_FENCES.format('panel')}", f"SELECT series_id, ts, i, {r(_CLIPPED, 5, 'y')} FROM panel JOIN fences USING (series_id)"
)
SQL["outliers_zscore"] = sql(
    f"{HOURLY}, s AS (SELECT series_id, avg(y) AS m, stddev_pop(y) AS sd, quantile_cont(y, 0.5) AS med FROM panel GROUP BY 1)",
    f"SELECT series_id, ts, i, {r('CASE WHEN abs((y - m) / sd) > 3 THEN med ELSE y END', 5, 'y')} FROM panel JOIN s USING (series_id)",
)
SQL["outliers_none"] = sql(HOURLY, _PICK.format(r("y", 5, "y")))
SQL["scale_standard"] = sql(DAILY, _PICK.format(r(f"(y - avg(y) OVER {ALL_}) / stddev_pop(y) OVER {ALL_}", 6, "y")))
SQL["scale_minmax"] = sql(
    DAILY, _PICK.format(r(f"(y - min(y) OVER {ALL_}) / (max(y) OVER {ALL_} - min(y) OVER {ALL_})", 6, "y"))
)
_SHIFTED = f"ln(y + CASE WHEN min(y) OVER {ALL_} <= 0 THEN -min(y) OVER {ALL_} + 1e-6 ELSE 0 END)"
SQL["scale_log"] = sql(DAILY, _PICK.format(r(_SHIFTED, 6, "y")))
SQL["scale_none"] = sql(DAILY, _PICK.format(r("y", 2, "y")))


def differenced(source: str, order: int, name: str = "panel") -> str:
    """CTEs ending in ``name``; each order takes one more difference, then rows are numbered anew."""
    steps, last = [], source
    for k in range(order):
        steps.append(f"{name}_{k} AS (SELECT series_id, ts, i, y - lag(y) OVER {W} AS y FROM {last})")
        last = f"{name}_{k}"
    return ", ".join(steps) + f", {name} AS (SELECT series_id, ts, row_number() OVER {W} - 1 AS i, y FROM {last} WHERE y IS NOT NULL)"


SQL["difference_once"] = sql(f"{DAILY}, {differenced('panel', 1, 'd')}", f"SELECT series_id, ts, i, {r('y', 2, 'y')} FROM d")
SQL["difference_twice"] = sql(f"{DAILY}, {differenced('panel', 2, 'd')}", f"SELECT series_id, ts, i, {r('y', 2, 'y')} FROM d")
SQL["scale_log_shifted"] = sql(f"{MONTHLY}, {differenced('panel', 1, 'd')}", f"SELECT series_id, ts, i, {r(_SHIFTED, 4, 'y')} FROM d")
_ROLL = f"CASE WHEN i >= 6 THEN avg(y) OVER {rows('6 PRECEDING', 'CURRENT ROW')} END"
SQL["rolling_trend"] = sql(DAILY, f"SELECT series_id, ts, i, {r('y', 2, 'y')}, {r(_ROLL, 2, 'trend')} FROM panel")
SQL["smooth_rolling"] = sql(
    f"{DAILY}, s AS (SELECT series_id, ts, i, {_ROLL} AS y FROM panel)",
    f"SELECT series_id, ts, i, {r(f'coalesce(y, {NEXT})', 2, 'y')} FROM s",
)
_PREPPED = f"""{_LINEAR}, {_FENCES.format('filled')},
clipped AS (SELECT series_id, ts, i, {_CLIPPED} AS y, y AS before_y, q1, q3 FROM filled JOIN fences USING (series_id)),
scaled AS (SELECT series_id, ts, i, (y - avg(y) OVER {ALL_}) / stddev_pop(y) OVER {ALL_} AS y FROM clipped),
{differenced('scaled', 1, 'done')}"""
SQL["prep_chain"] = sql(_PREPPED, f"SELECT series_id, ts, i, {r('y', 5, 'y')} FROM done")
SQL["prep_log"] = sql(
    _PREPPED + """,
gaps AS (SELECT series_id, count(*) - count(y) AS k, count(*) AS n FROM panel GROUP BY 1),
hits AS (SELECT series_id, count(*) FILTER (WHERE before_y <> y) AS k FROM clipped GROUP BY 1)""",
    """SELECT series_id, CAST(1 AS BIGINT) AS step, k AS affected,
  printf('Missing values: %d → 0 using [Linear interpolation]', k) AS message FROM gaps
UNION ALL SELECT series_id, 2, k, printf('Outliers handled: ~%d adjusted using [IQR clipping (±1.5 IQR)]', k) FROM hits
UNION ALL SELECT series_id, 3, n, 'Applied StandardScaler (mean 0, std 1).' FROM gaps
UNION ALL SELECT series_id, 4, 1, 'Applied differencing of order 1.' FROM gaps""",
)

SQL["exact_quantiles"] = (
    "SELECT o_orderpriority AS series_id, "
    + ", ".join(r(f"quantile_cont(o_totalprice, {p})", 3, n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))
    + " FROM orders GROUP BY 1"
)
SQL["features_basic"] = sql(
    f"{MIXED}, {FREQ}, {BASIC}",
    f"SELECT series_id, dataset_size, date_range, {r('missing_pct', 4, 'missing_pct')}, true AS univariate, frequency "
    "FROM basic JOIN freqs USING (series_id)",
)
_MOM = ["mean", "std", "median"]
SQL["features_statistical"] = sql(
    f"{MIXED}, {STATS}, {MOMENTS}",
    "SELECT series_id, outliers_count, " + ", ".join(r(c, 3, c) for c in [*_MOM, "outlier_pct"]) + ", "
    + ", ".join(r(f'"{c}"', 3, f'"{c}"') for c in ("min", "max")) + ", "
    + ", ".join(r(c, 6, c) for c in ("skewness", "kurtosis", "cv")) + " FROM momf",
)
SQL["trend_line"] = sql(
    f"{MIXED}, {LINE}",
    f"SELECT series_id, points, {r('slope', 4, 'slope')}, {r('intercept', 4, 'intercept')}, {r('r', 7, 'r')}, {r('t', 6, 't')}, "
    f"{r('p_value', 6, 'p_value')} FROM line",
)
SQL["trend_flags"] = sql(
    f"{MIXED}, {LINE}, {TREND}",
    f"SELECT series_id, has_trend, trend_direction, {r('trend_slope', 5, 'trend_slope')}, {r('trend_linearity', 7, 'trend_linearity')} FROM flags",
)
SQL["trend_strength"] = sql(f"{MIXED}, {LINE}, {TREND12}", f"SELECT series_id, {r('trend_strength', 6, 'trend_strength')} FROM tstr")
SQL["seasonality"] = sql(
    f"{MIXED}, {FREQ}, {SEASON}",
    "SELECT series_id, share > 0.3 AS has_seasonality, CAST(CASE WHEN share > 0.3 THEN period END AS BIGINT) AS seasonal_period, "
    f"{r('share', 6, 'seasonality_strength')} FROM seas",
)
SQL["unit_root_plain"] = sql(
    f"{MIXED}, {ROOT}",
    f"SELECT series_id, {r('adf_statistic', 5, 'adf_statistic')}, {r('adf_p_value', 5, 'adf_p_value')}, "
    "CAST(0 AS BIGINT) AS used_lag, adf_p_value < 0.05 AS is_stationary FROM root",
)
_COLS = ["dz", "1.0", "z1", "dz1", "dz2", "dz3"]
SQL["unit_root_sums"] = sql(
    f"""{MIXED}, {STATS},
zrows AS (SELECT panel.series_id, i, (y - m) / sp AS z FROM panel JOIN means USING (series_id)),
dz0 AS (SELECT series_id, i, z - lag(z) OVER {W} AS dz, lag(z) OVER {W} AS z1 FROM zrows),
dzs AS (SELECT series_id, i, dz, z1, lag(dz, 1) OVER {W} AS dz1, lag(dz, 2) OVER {W} AS dz2, lag(dz, 3) OVER {W} AS dz3 FROM dz0)""",
    " UNION ALL ".join(
        f"SELECT series_id, CAST({a * 6 + b} AS BIGINT) AS entry, {r(f'sum({x} * {y})', 6, 'total')} FROM dzs WHERE i >= 4 GROUP BY 1"
        for a, x in enumerate(_COLS)
        for b, y in enumerate(_COLS)
    ),
)
SQL["level_stationarity"] = sql(
    f"{MIXED}, {STATS}, {KPSS}",
    f"SELECT series_id, {r('kpss_statistic', 6, 'kpss_statistic')}, kpss_lag, {r('kpss_p_value', 6, 'kpss_p_value')} FROM level",
)
_BANDS = f"{r('-band', 7, 'lower')}, {r('band', 7, 'upper')}"
SQL["acf_values"] = sql(
    f"{MIXED}, {STATS}", f"SELECT series_id, CAST(k AS BIGINT) AS lag, {r('acf', 7, 'acf')}, {_BANDS} FROM acfs WHERE k <= least(40, n // 2)"
)
SQL["acf_pacf_frame"] = sql(
    f"{MIXED}, {STATS}, {PACF}",
    f"SELECT a.series_id, CAST(a.k AS BIGINT) AS lag, {r('acf', 6, 'acf')}, {r('pacf', 6, 'pacf')}, {r('-band', 6, 'lower')}, "
    f"{r('band', 6, 'upper')} FROM acfs a LEFT JOIN pacfs p ON p.series_id = a.series_id AND p.k = a.k WHERE a.k <= least(40, n // 2)",
    recursive=True,
)
SQL["lag_features"] = sql(
    f"{MIXED}, {STATS}, {PACF}, {LAGS}",
    f"SELECT series_id, {r('lag_1_acf', 6, 'lag_1_acf')}, CAST(pacf_order AS BIGINT) AS pacf_order, {REC_TEXT} AS recommended_lags, "
    "CAST(max_acf_lag AS BIGINT) AS max_acf_lag FROM lagf",
    recursive=True,
)
SQL["change_features"] = sql(
    f"{MIXED}, {STATS}, {CHANGES}",
    f"SELECT series_id, {r('mean_abs_change', 3, 'mean_abs_change')}, {r('std_1st_diff', 3, 'std_1st_diff')}, "
    f"{r('zero_crossing_rate', 7, 'zero_crossing_rate')} FROM chg",
)
_DIGITS = {
    "missing_pct": 5, "mean": 3, "std": 3, "median": 3, "min": 2, "max": 2, "skewness": 5, "kurtosis": 5, "cv": 5, "outlier_pct": 5,
    "trend_slope": 4, "trend_linearity": 5, "trend_strength": 5, "seasonality_strength": 5, "adf_statistic": 5, "adf_p_value": 5,
    "lag_1_acf": 5, "mean_abs_change": 3, "std_1st_diff": 3, "zero_crossing_rate": 5,
}
SQL["features_all"] = sql(
    FEATURES,
    "SELECT series_id, dataset_size, date_range, univariate, frequency, outliers_count, has_trend, trend_direction, has_seasonality, "
    "CAST(seasonal_period AS BIGINT) AS seasonal_period, is_stationary, CAST(pacf_order AS BIGINT) AS pacf_order, "
    f"{REC_TEXT} AS recommended_lags, CAST(max_acf_lag AS BIGINT) AS max_acf_lag, CAST(score AS BIGINT) AS data_complexity_score, "
    + ", ".join(r(f'"{c}"', d, f'"{c}"') for c, d in _DIGITS.items()) + " FROM features",
    recursive=True,
)
SQL["complexity_score"] = sql(FEATURES, "SELECT series_id, CAST(score AS BIGINT) AS data_complexity_score FROM features", True)
SQL["features_json"] = sql(
    FEATURES,
    "SELECT series_id, printf('{\"dataset_size\":%d,\"frequency\":\"%s\",\"has_trend\":%s,\"has_seasonality\":%s}', dataset_size, frequency, "
    "CAST(has_trend AS VARCHAR), CAST(has_seasonality AS VARCHAR)) AS features_json FROM features",
    True,
)
_PARTS = ("y", "trend", "seasonal", "resid")
SQL["decomposition"] = sql(
    f"{HOURLY}, {FREQ}, {by_frequency()}",
    "SELECT series_id, ts, i, CAST(period AS BIGINT) AS period, " + ", ".join(r(c, 10, c) for c in _PARTS) + " FROM season_parts",
)
SQL["decomposition_daily"] = sql(
    f"{DAILY}, {decomposed('d7', 'panel', 7)}",
    "SELECT series_id, ts, i, CAST(period AS BIGINT) AS period, " + ", ".join(r(c, 2, c) for c in _PARTS) + " FROM d7",
)
_M12 = f"{MONTHLY}, {decomposed('d12', 'panel', 12)}"
SQL["decomposition_frame"] = sql(
    _M12,
    " UNION ALL ".join(
        f"SELECT series_id, ts, '{n}' AS component, {r(c, 4, 'value')} FROM d12"
        for n, c in (("Observed", "y"), ("Trend", "trend"), ("Seasonal", "seasonal"), ("Residual", "resid"))
    ),
)
SQL["before_after"] = sql(
    f"{HOURLY}, {_FENCES.format('panel')}",
    f"SELECT series_id, ts, {r('y', 5, 'original')}, {r(_CLIPPED, 5, 'processed')} FROM panel JOIN fences USING (series_id)",
)
SQL["calendar_profile"] = sql(
    f"""{MIXED}, {FREQ},
kinds AS (SELECT series_id, frequency IN ('H', 'D') AS weekly FROM freqs),
seen AS (SELECT series_id, CASE WHEN weekly THEN isodow(ts) - 1 ELSE month(ts) END AS slot, avg(y) AS mean_y
  FROM panel JOIN kinds USING (series_id) GROUP BY 1, 2),
slots AS (SELECT series_id, weekly, unnest(CASE WHEN weekly THEN range(0, 7) ELSE range(1, 13) END) AS slot FROM kinds)""",
    "SELECT series_id, CASE WHEN weekly THEN 'weekday' ELSE 'month' END AS kind, CAST(slot AS BIGINT) AS slot, "
    f"{r('mean_y', 3, 'mean_y')} FROM slots LEFT JOIN seen USING (series_id, slot)",
)
_YES = "CASE WHEN {} THEN 'Yes' ELSE 'No' END"
_CARDS = {
    "Dataset Info": [
        "printf('Size: %d observations', dataset_size)", "'Frequency: ' || frequency", "printf('Missing: %.1f%%', missing_pct)",
        "printf('Outliers: %.1f%%', outlier_pct)",
    ],
    "Trend Analysis": [
        f"'Trend: ' || {_YES.format('has_trend')}",
        "'Direction: ' || upper(trend_direction[1]) || trend_direction[2:]",
        "printf('Strength: %.2f', trend_strength)", "printf('Slope: %.4f', trend_slope)",
    ],
    "Seasonality": [
        f"'Seasonal: ' || {_YES.format('has_seasonality')}", "'Period: ' || coalesce(CAST(seasonal_period AS VARCHAR), 'N/A')",
        "printf('Strength: %.2f', seasonality_strength)",
    ],
    "Stationarity": [
        f"'Stationary: ' || {_YES.format('is_stationary')}", "printf('ADF p-value: %.4f', adf_p_value)",
        "'Interpretation: ' || CASE WHEN is_stationary THEN 'Stationary' ELSE 'Needs differencing' END",
    ],
    "Autocorrelation": [
        "printf('Lag-1 ACF: %.3f', lag_1_acf)", "printf('AR order hint: %d', pacf_order)",
        "'Key lags: [' || array_to_string(rec[1:3], ', ') || ']'",
        "'Strength: ' || CASE WHEN abs(lag_1_acf) > 0.7 THEN 'Strong' WHEN abs(lag_1_acf) > 0.3 THEN 'Moderate' ELSE 'Weak' END",
    ],
    "Complexity Score": [
        "printf('Score: %d/10', score)",
        "'Level: ' || CASE WHEN score < 4 THEN 'Simple' WHEN score < 7 THEN 'Moderate' ELSE 'Complex' END",
        "'Hybrid: ' || CASE WHEN score >= 7 THEN 'Recommended' ELSE 'Optional' END",
    ],
}
SQL["stat_cards"] = sql(
    FEATURES,
    " UNION ALL ".join(
        f"SELECT series_id, '{card}' AS card, CAST({no} AS BIGINT) AS line_no, {line} AS line FROM features"
        for card, lines in _CARDS.items()
        for no, line in enumerate(lines)
    ),
    True,
)
SQL["evidence_trend"] = sql(
    f"{MIXED}, {LINE}",
    """SELECT series_id, 'trend' AS topic, CAST(0 AS BIGINT) AS line_no, CASE WHEN p_value < 0.05
  THEN printf('Linear regression: significant %s trend (p = %.4f).', CASE WHEN slope > 0 THEN 'upward' ELSE 'downward' END, p_value)
  ELSE printf('Linear regression: no significant linear trend (p = %.4f).', p_value) END AS line FROM line
UNION ALL SELECT series_id, 'trend', 1, printf('Slope = %.4f, R² = %.3f.', slope, r * r) FROM line WHERE p_value < 0.05""",
)
SQL["evidence_seasonality"] = sql(
    _M12 + """,
vs AS (SELECT series_id, var_samp(seasonal) AS sv, var_samp(resid) AS rv FROM d12 GROUP BY 1),
sh AS (SELECT *, greatest(0, 1 - rv / (sv + rv)) AS share FROM vs)""",
    """SELECT series_id, 'seasonality' AS topic, CAST(0 AS BIGINT) AS line_no,
  printf('Seasonal variance = %.3f, residual variance = %.3f.', sv, rv) AS line FROM sh
UNION ALL SELECT series_id, 'seasonality', 1, printf('Seasonality strength ≈ %.1f%%.', share * 100) FROM sh
UNION ALL SELECT series_id, 'seasonality', 2, CASE WHEN share > 0.6 THEN 'Strong repeating seasonal pattern present.'
  WHEN share > 0.3 THEN 'Moderate seasonal pattern present.' ELSE 'Only weak seasonal pattern detected.' END FROM sh""",
)
SQL["evidence_stationarity"] = sql(
    f"{MIXED}, {STATS}, {ROOT}, {KPSS}",
    """SELECT series_id, 'stationarity' AS topic, CAST(0 AS BIGINT) AS line_no,
  printf('ADF test: statistic = %.3f, p = %.4f.', adf_statistic, adf_p_value) AS line FROM root
UNION ALL SELECT series_id, 'stationarity', 1, CASE WHEN adf_p_value < 0.05 THEN 'ADF suggests the series is stationary (rejects unit root).'
  ELSE 'ADF suggests the series is non-stationary (fails to reject unit root).' END FROM root
UNION ALL SELECT series_id, 'stationarity', 2, printf('KPSS test: statistic = %.3f, p = %.4f.', kpss_statistic, kpss_p_value) FROM level
UNION ALL SELECT series_id, 'stationarity', 3, CASE WHEN kpss_p_value > 0.05 THEN 'KPSS suggests the series is stationary.'
  ELSE 'KPSS suggests the series is non-stationary.' END FROM level""",
)
SQL["evidence_autocorrelation"] = sql(
    f"{MIXED}, {STATS}, {PACF}, {LAGS}",
    """SELECT series_id, 'autocorrelation' AS topic, CAST(0 AS BIGINT) AS line_no, CASE WHEN len(lags) > 0
  THEN 'ACF: significant correlation at lags [' || array_to_string(lags[1:5], ', ') || '].'
  ELSE 'ACF: no clearly significant lags.' END AS line FROM sig
UNION ALL SELECT series_id, 'autocorrelation', 1, printf('PACF: suggests AR order around %d.', pacf_order) FROM psig WHERE pacf_order > 0""",
    True,
)
SQL["pattern_summary"] = sql(
    FEATURES,
    """SELECT series_id, CAST(0 AS BIGINT) AS line_no, CASE WHEN NOT has_trend THEN 'The data does not show a clear long‑term upward or downward trend.'
  WHEN trend_strength > 0.7 THEN printf('The data has a strong %s trend over time.', trend_direction)
  WHEN trend_strength > 0.4 THEN printf('The data shows a moderate %s trend.', trend_direction)
  ELSE printf('There is only a weak %s trend.', trend_direction) END AS line FROM features
UNION ALL SELECT series_id, 1, CASE WHEN has_seasonality THEN printf('There is a clear seasonal pattern repeating every %d time steps', seasonal_period)
    || CASE seasonal_period WHEN 7 THEN ' (roughly weekly seasonality).' WHEN 12 THEN ' (roughly yearly seasonality for monthly data).' ELSE '.' END
  WHEN score >= 7 THEN 'The series does not follow a fixed calendar pattern but moves in irregular waves, which is more like **cyclical** behaviour than standard seasonality.'
  ELSE 'No strong calendar‑based seasonal pattern is detected.' END FROM features
UNION ALL SELECT series_id, 2, CASE WHEN is_stationary THEN 'Overall, the series looks statistically stable over time (stationary).'
  ELSE 'The series is not stationary; applying differencing or detrending will help many models.' END FROM features""",
    True,
)

for _name, _task in zip(("forecasting", "classification", "anomaly", "clustering"), ("Forecasting", *LISTED_RULES)):
    SQL[f"rules_{_name}"] = sql(FEATURES, ranked(_task), True)
SQL["rules_all_tasks"] = sql(
    FEATURES + ", found AS (" + " UNION ALL ".join(f"({ranked(t)})" for t in ("Forecasting", *LISTED_RULES)) + """),
asked AS (SELECT series_id, unnest(['Forecasting', 'Classification', 'Anomaly Detection', 'Clustering', 'Unknown']) AS task FROM features)""",
    "SELECT series_id, task, max(name) FILTER (WHERE rank = 1) AS primary_name, count(name) FILTER (WHERE rank > 1) AS n_alternatives "
    "FROM asked LEFT JOIN found USING (series_id, task) GROUP BY 1, 2",
    True,
)
SQL["hybrid_suggestion"] = sql(
    FEATURES,
    "SELECT series_id, " + ", ".join(
        f"CASE WHEN score >= 7 THEN {v} END AS {k}"
        for k, v in (
            ("combo", quoted(HYBRID_TEXT["combo"])),
            ("rationale", f"printf({quoted(HYBRID_TEXT['rationale'])}, score)"),
            ("approach", quoted(HYBRID_TEXT["approach"])),
        )
    ) + " FROM features",
    True,
)
SQL["hybrid_decision"] = sql(
    DECIDED,
    f"""SELECT series_id, ai AS ai_name, {r('a', 5, 'ai_confidence')}, rule_name, {r('r', 5, 'rule_confidence')}, final_name,
  {r('final_confidence', 5, 'final_confidence')},
  CASE WHEN kind IN ('h', 'ha') THEN concat_ws('; ', printf('AI model has high confidence (%.1f%%)', a * 100),
      printf('Primary recommendation: %s (AI-driven)', ai),
      CASE WHEN kind = 'ha' THEN printf('Rule-based system agrees: %s', rule_name)
        WHEN rule_name IS NOT NULL THEN printf('Note: Rule-based system suggested %s, but AI has stronger evidence', rule_name) END)
    WHEN kind = 'ma' THEN concat_ws('; ', printf('Both AI (%.1f%%) and rules agree on %s', a * 100, ai), 'High consensus recommendation')
    WHEN kind = 'm' THEN concat_ws('; ', printf('AI suggestion (%s, %.1f%%) has higher weighted score', ai, a * 100),
      printf('Rule-based suggested %s as alternative', coalesce(rule_name, 'None')))
    WHEN kind = 'mr' THEN concat_ws('; ', 'Using rule-based recommendation due to low AI confidence',
      printf('AI suggested %s but with only %.1f%% confidence', ai, a * 100))
    ELSE concat_ws('; ', 'Using rule-based recommendation (AI unavailable or low confidence)',
      printf('AI prediction (%s) had insufficient confidence (%.1f%%)', ai, a * 100)) END AS reasoning FROM finals""",
    True,
)
_RULE_ID = "CASE name WHEN 'Exponential Smoothing (ETS)' THEN 'ETS' WHEN 'XGBoost with Lag Features' THEN 'XGBoost' ELSE name END"
SQL["final_details"] = sql(
    DECIDED + f", named AS (SELECT *, {_RULE_ID} AS id FROM rules)",
    """SELECT f.series_id, f.final_name, max(category) FILTER (WHERE id = final_id) AS category,
  coalesce(string_agg(name, '; ' ORDER BY rank) FILTER (WHERE rank > 1 AND id IS DISTINCT FROM final_id), '') AS other_names
FROM finals f LEFT JOIN named USING (series_id) GROUP BY 1, 2""",
    True,
)
SQL["decision_comparison"] = sql(
    DECIDED,
    """SELECT series_id, 'AI Meta-Model' AS method, ai AS prediction, printf('%.1f%%', a * 100) AS confidence, '80%' AS weight,
  'Trained on benchmarked series' AS basis FROM finals WHERE ok
UNION ALL SELECT series_id, 'Rule-Based', rule_name, printf('%.0f%%', r * 100), '20%', 'Statistical tests + heuristics' FROM finals WHERE rule_name IS NOT NULL
UNION ALL SELECT series_id, 'Final Hybrid', coalesce(final_name, 'N/A'), printf('%.1f%%', final_confidence * 100), '100%', 'Weighted combination' FROM finals""",
    True,
)
SQL["meta_inputs"] = sql(
    FEATURES,
    'SELECT series_id, CAST(dataset_size AS DOUBLE) AS length, ' + r("cv", 5, "cv") + ", " + r('"max" - "min"', 2, '"range"') + ", "
    + r("seasonality_strength", 5, "seasonal_strength") + ", " + r("adf_p_value", 5, "adf_pvalue") + ", " + r("lag_1_acf", 5, "autocorr_lag1")
    + ", " + r("lag_1_acf * dataset_size / (dataset_size - 1)", 5, "pacf_lag1")
    + ", CASE WHEN is_stationary THEN 0.0 ELSE 1.0 END AS diff_needed, " + r("zero_crossing_rate", 5, "zero_crossing_rate") + " FROM features",
    True,
)
SQL["parameter_hints"] = sql(
    FEATURES,
    "SELECT series_id, CAST(least(pacf_order, 3) AS BIGINT) AS p, CAST(CASE WHEN is_stationary THEN 0 ELSE 1 END AS BIGINT) AS d, "
    "CAST(1 AS BIGINT) AS q FROM features",
    True,
)

SQL["holdout_split"] = sql(SPLIT, f"SELECT series_id, ts, i, {r('y', 5, 'y')}, n, n_train, i < n_train AS is_train FROM parts")
SQL["naive_forecast"] = sql(NAIVE, f"SELECT series_id, model, ts, h, {r('y', 5, 'y')}, {r('yhat', 5, 'yhat')} FROM made")
SQL["naive_vs_actual"] = sql(
    NAIVE, f"SELECT series_id, ts, {r('y', 5, 'actual')}, model, {r('yhat', 5, 'yhat')} FROM made WHERE model = 'Seasonal Naive'"
)
_FOUR = ("mae", "rmse", "mape", "r2")
SQL["forecast_metrics"] = sql(NAIVE, "SELECT series_id, model, points, " + ", ".join(r(c, 5, c) for c in _FOUR) + " FROM scored")
SQL["model_ranking"] = sql(NAIVE, f"SELECT series_id, model, {r('mae', 5, 'mae')}, rank, rank = 1 AS is_best FROM ranks")
SQL["metrics_chart"] = sql(
    NAIVE,
    " UNION ALL ".join(f"SELECT series_id, model, rank = 1 AS is_best, '{c}' AS metric, {r(c, 5, 'value')} FROM ranks" for c in _FOUR),
)
SQL["seasonal_difference"] = sql(
    f"""{MIXED}, sized AS (SELECT *, CAST(floor(count(*) OVER {ALL_} * 0.8) AS BIGINT) AS n_train FROM panel),
w AS (SELECT series_id, i, n_train, y - lag(y, 1) OVER {W} - lag(y, 12) OVER {W} + lag(y, 13) OVER {W} AS w FROM sized WHERE i < n_train),
deep AS (SELECT series_id, max(n_train) AS n, CASE
  WHEN max(n_train) - 13 - 13 - 24 >= 38 THEN 37 WHEN max(n_train) - 13 - 13 - 12 >= 23 THEN 25
  WHEN max(n_train) - 13 - 13 - 12 >= 18 THEN 25 ELSE 14 END AS depth FROM w GROUP BY 1)""",
    f"SELECT w.series_id, {r('sqrt(sum(w * w))', 3, 'root_sum')} FROM w JOIN deep USING (series_id) WHERE i >= 13 + depth GROUP BY 1",
)
SQL["forecast_smoothing_fixed"] = sql(
    f"""{MONTHLY}, sized AS (SELECT *, CAST(floor(count(*) OVER {ALL_} * 0.8) AS BIGINT) AS n_train FROM panel),
firsts AS (SELECT series_id, avg(y) FILTER (WHERE i < 12) AS m1, avg(y) FILTER (WHERE i BETWEEN 12 AND 23) AS m2,
  list(y ORDER BY i) FILTER (WHERE i < 12) AS head FROM sized GROUP BY 1),
begins AS (SELECT series_id, head, (m2 - m1) / 12 AS slope, m1 - (m2 - m1) / 12 * 6.5 AS level FROM firsts),
states AS (SELECT series_id, 0::BIGINT AS i, level, slope, list_transform(range(1, 13), lambda k: head[k] - (level + slope * k)) AS season,
    0::DOUBLE AS sse FROM begins
  UNION ALL
  SELECT series_id, i + 1, level + slope + 0.3 * e, slope + 0.03 * e,
    list_transform(range(1, 13), lambda k: season[k] + CASE WHEN k = i % 12 + 1 THEN 0.2 * e ELSE 0 END), sse + e * e
  FROM (SELECT s.*, x.y - s.level - s.slope - s.season[s.i % 12 + 1] AS e FROM states s JOIN sized x USING (series_id, i) WHERE s.i < x.n_train))""",
    f"""SELECT x.series_id, x.ts, x.i - x.n_train + 1 AS h, {r('s.level + (x.i - x.n_train + 1) * s.slope + s.season[x.i % 12 + 1]', 3, 'yhat')},
  {r('sqrt(s.sse)', 3, 'root_sse')} FROM states s JOIN sized x ON x.series_id = s.series_id AND s.i = x.n_train AND x.i >= x.n_train""",
    True,
)
SQL["benchmark_failed"] = sql(
    f"{MONTHLY}, sized AS (SELECT series_id, floor(count(*) * 0.8) AS n_train FROM panel GROUP BY 1)",
    """SELECT series_id, 'Exponential Smoothing' AS model, 'failed' AS status, 'fewer rows than two seasons' AS error FROM sized WHERE n_train < 104
UNION ALL SELECT series_id, 'STL + ETS (Hybrid)', 'failed', 'fewer rows than two seasons' FROM sized WHERE n_train < 104
UNION ALL SELECT series_id, 'SARIMA', 'failed', 'too few observations for the model' FROM sized WHERE n_train - 53 - 54 < 8""",
)
_LAGGED = ", ".join(f"lag(y, {k}) OVER {W} AS lag_{k}" for k in (1, 2, 3, 7, 14))
SQL["lag_frame"] = sql(
    f"{SPLIT}, lagged AS (SELECT series_id, ts, i, n, y, {_LAGGED} FROM parts)",
    f"SELECT series_id, ts, {r('y', 5, 'y')}, " + ", ".join(r(f"lag_{k}", 5, f"lag_{k}") for k in (1, 2, 3, 7, 14))
    + ", i - 14 < floor((n - 14) * 0.8) AS is_train FROM lagged WHERE i >= 14",
)
_SLOT_COLS = ", ".join(f"max(v) FILTER (WHERE k = {k}) AS slot_{k}" for k in range(1, 6))
SQL["lag_slots"] = sql(
    f"{MIXED}, {STATS}, {PACF}, {LAGS}, lagged AS MATERIALIZED (SELECT series_id, rec, list_max(rec) AS top FROM lagf), "
    f"sized AS MATERIALIZED (SELECT *, count(*) OVER {ALL_} AS n FROM panel), "
    "wanted AS MATERIALIZED (SELECT series_id, i, k, i - coalesce(rec[k], rec[len(rec)]) AS j "
    "FROM sized JOIN lagged USING (series_id), generate_series(1, 5) g(k)), "
    "found AS MATERIALIZED (SELECT w.series_id, w.i, w.k, s.y AS v FROM wanted w JOIN sized s ON s.series_id = w.series_id AND s.i = w.j), "
    f"slotted AS MATERIALIZED (SELECT series_id, i, {_SLOT_COLS} FROM found GROUP BY 1, 2 HAVING count(*) = 5)",
    f"SELECT series_id, ts, {r('y', 4, 'y')}, " + ", ".join(r(f"slot_{k}", 4, f"slot_{k}") for k in range(1, 6))
    + ", i - top < floor((n - top) * 0.8) AS is_train FROM slotted JOIN sized USING (series_id, i) JOIN lagged USING (series_id)",
    recursive=True,
)

_D7 = f"{DAILY}, {decomposed('d7', 'panel', 7)}"
SQL["anomalies_residual"] = sql(
    _D7 + ", sc AS (SELECT series_id, avg(resid) AS c, stddev_samp(resid) AS s FROM d7 GROUP BY 1)",
    f"SELECT series_id, ts, i, {r('y', 2, 'y')}, {r('resid', 2, 'resid')}, {r('(resid - c) / s', 6, 'z')} "
    "FROM d7 JOIN sc USING (series_id) WHERE abs((resid - c) / s) > 3",
)
_SEVEN = rows("6 PRECEDING", "CURRENT ROW")
SQL["isolation_inputs"] = sql(
    f"""{HOURLY}, f AS (SELECT series_id, ts, i, y, lag(y) OVER {W} AS lag_1, count(y) OVER {_SEVEN} AS k,
  avg(y) OVER {_SEVEN} AS rolling_mean, stddev_samp(y) OVER {_SEVEN} AS rolling_std FROM panel)""",
    "SELECT series_id, ts, i, " + ", ".join(r(c, 5, c) for c in ("y", "lag_1", "rolling_mean", "rolling_std")) + " FROM f WHERE k = 7",
)
SQL["error_threshold"] = sql(
    f"""{HOURLY}, e AS (SELECT series_id, ts, i, pow(y - avg(y) OVER {ALL_}, 2) AS mse FROM panel),
t AS (SELECT *, avg(mse) OVER {ALL_} + 2 * stddev_pop(mse) OVER {ALL_} AS threshold FROM e)""",
    f"SELECT series_id, ts, i, {r('mse', 4, 'mse')}, {r('threshold', 4, 'threshold')}, mse > threshold AS is_anomaly FROM t",
)
SQL["classification_report"] = f"""WITH classes AS (SELECT unnest(list_distinct(list(quality) || list(toxic))) AS c FROM labels),
counts AS (SELECT c, count(*) FILTER (WHERE quality = c) AS support, count(*) FILTER (WHERE toxic = c) AS called,
  count(*) FILTER (WHERE quality = c AND toxic = c) AS hits FROM classes, labels GROUP BY 1),
rates AS (SELECT *, CASE WHEN called = 0 THEN 0 ELSE hits * 1.0 / called END AS p, CASE WHEN support = 0 THEN 0 ELSE hits * 1.0 / support END AS q FROM counts)
SELECT CAST(c AS VARCHAR) AS "class", {r('p', 6, 'precision')}, {r('q', 6, 'recall')},
  {r('CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END', 6, 'f1')}, support,
  {r('(SELECT count(*) FILTER (WHERE quality = toxic) * 1.0 / count(*) FROM labels)', 6, 'accuracy')} FROM rates"""
_POINTS = """raw AS (SELECT o_custkey AS id, avg(o_totalprice) AS a, CAST(count(*) AS DOUBLE) AS b FROM orders GROUP BY 1),
pts AS (SELECT id, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS x, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS y FROM raw),
near AS (SELECT p.id AS p, q.id AS q FROM pts p JOIN pts q ON abs(p.x - q.x) <= 0.2 AND abs(p.y - q.y) <= 0.2
  AND pow(p.x - q.x, 2) + pow(p.y - q.y, 2) <= 0.2 * 0.2),
cores AS (SELECT p AS id FROM near GROUP BY 1 HAVING count(*) >= 5),
links AS (SELECT p, q FROM near SEMI JOIN cores c ON near.p = c.id SEMI JOIN cores d ON near.q = d.id),
reach AS (SELECT id, id AS root FROM cores UNION SELECT l.q, r.root FROM reach r JOIN links l ON l.p = r.id WHERE r.root < l.q),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY 1),
border AS (SELECT p AS id, min(root) AS root FROM near JOIN roots ON near.q = roots.id WHERE p NOT IN (SELECT id FROM cores) GROUP BY 1),
done AS (SELECT pts.id, c.root IS NOT NULL AS is_core, coalesce(c.root, b.root, -1) AS cluster
  FROM pts LEFT JOIN roots c USING (id) LEFT JOIN border b ON b.id = pts.id)"""
SQL["cluster_density"] = sql(_POINTS, "SELECT * FROM done", True)
SQL["cluster_density_sizes"] = sql(_POINTS, "SELECT cluster, count(*) AS members FROM done GROUP BY 1", True)
SQL["calendar_columns"] = sql(
    DAILY,
    f"SELECT series_id, ts, i, {r('y', 2, 'y')}, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week, CAST(month(ts) AS BIGINT) AS month, "
    "CAST(day(ts) AS BIGINT) AS day_of_month FROM panel",
)
SQL["sliding_sequences"] = sql(
    f"{MONTHLY}, s AS (SELECT series_id, ts, i, y, list(CAST(y AS BIGINT)) OVER {rows('30 PRECEDING', '1 PRECEDING')} AS v FROM panel)",
    f"SELECT series_id, ts, i, array_to_string(v, ',') AS inputs, {r('y', 2, 'label')} FROM s WHERE i >= 30",
)
SQL["first_labels"] = "SELECT CAST(user_id AS VARCHAR) AS series_id, min_by(event_type, ts) AS label FROM events GROUP BY 1"
