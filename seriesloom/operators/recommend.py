"""Rule-based recommendation for four tasks and the decision between rules and classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.texts import TEXTS
from seriesloom.operators.evidence import fmt, list_text
from seriesloom.panel import KEY

TASKS = ["Forecasting", "Classification", "Anomaly Detection", "Clustering"]

# Method names, categories and the wording of reasons, pros and cons.
# A reason with %-places takes the feature listed beside it.
FORECASTING_TEXT = {
    "SARIMA": (
        "Statistical",
        [
            ("Strong seasonality detected (period=%d)", "seasonal_period"),
            "Non-stationary data (needs differencing)",
            "Medium dataset size suitable for SARIMA",
            ("Seasonal strength: %.2f", "seasonality_strength"),
        ],
        [
            "Handles both trend and seasonality",
            "Well-tested classical method",
            "Interpretable parameters",
            "Works well with seasonal patterns",
        ],
        [
            "Requires careful parameter tuning",
            "Assumes linear relationships",
            "Can be slow on very large datasets",
        ],
    ),
    "Prophet": (
        "ML",
        [
            "Handles multiple seasonal patterns well",
            "Robust to missing data and outliers",
            "Good for business time series",
            "Minimal parameter tuning required",
        ],
        [
            "Easy to use, minimal tuning",
            "Handles holidays and special events",
            "Works with irregular data",
            "Provides uncertainty intervals",
        ],
        [
            "Less control than SARIMA",
            "Can overfit with too many parameters",
            "Requires sufficient historical data",
        ],
    ),
    "ARIMA": (
        "Statistical",
        [
            "Trend detected without seasonality",
            ("Non-stationary: %s", "non_stationary_text"),
            "Classical approach suitable for this pattern",
            ("Dataset size: %d observations", "dataset_size"),
        ],
        [
            "Well-established methodology",
            "Good for univariate forecasting",
            "Handles non-stationarity via differencing",
            "Interpretable results",
        ],
        [
            "Requires stationarity transformation",
            "Parameter selection can be complex",
            "Assumes linear relationships",
        ],
    ),
    "Exponential Smoothing (ETS)": (
        "Statistical",
        [
            "Simple pattern detected",
            "Small to medium dataset",
            "Fast and efficient method",
            ("Complexity score: %d/10", "data_complexity_score"),
        ],
        [
            "Very fast computation",
            "Simple to understand and implement",
            "Good for short-term forecasts",
            "Minimal computational resources",
        ],
        [
            "Limited to simple patterns",
            "No external variables support",
            "May underperform on complex data",
        ],
    ),
    "XGBoost with Lag Features": (
        "ML",
        [
            ("Large dataset (%d observations)", "dataset_size"),
            ("Complex patterns (score: %d/10)", "data_complexity_score"),
            "Can capture non-linear relationships",
            ("Recommended lags: %s", "lags_text"),
        ],
        [
            "Handles non-linear patterns well",
            "Can include external features",
            "Fast training and prediction",
            "Robust to outliers",
        ],
        [
            "Requires feature engineering",
            "Less interpretable than statistical models",
            "Needs careful lag selection",
        ],
    ),
    "LSTM (Deep Learning)": (
        "Deep Learning",
        [
            ("Very large dataset (%d observations)", "dataset_size"),
            "Highly complex patterns detected",
            "Can capture long-term dependencies",
            ("Strong autocorrelation: %.2f", "lag_1_acf"),
        ],
        [
            "Captures complex sequential patterns",
            "Handles long-term dependencies",
            "Can model multivariate inputs",
            "State-of-the-art for complex data",
        ],
        [
            "Requires large amounts of data",
            "Computationally expensive",
            "Difficult to interpret",
            "Needs careful hyperparameter tuning",
        ],
    ),
}
OTHER_TEXT = {
    "Random Forest Classifier": (
        "ML",
        [
            "Robust ensemble method",
            "Handles non-linear patterns well",
            "Works with extracted time series features",
        ],
        ["Easy to use", "Handles outliers", "Feature importance"],
        ["Can overfit", "Less interpretable"],
    ),
    "LSTM Classifier": (
        "Deep Learning",
        ["Large dataset available", "Captures sequential patterns", "End-to-end learning"],
        ["Learns from raw sequences", "High accuracy potential"],
        ["Requires more data", "Complex to tune"],
    ),
    "k-NN with DTW": (
        "ML",
        ["Distance-based classification", "Works well with time series similarity", "Interpretable results"],
        ["Simple method", "No training required", "Intuitive"],
        ["Slow on large datasets", "Sensitive to noise"],
    ),
    "STL Decomposition + Z-Score": (
        "Statistical",
        [
            "Strong seasonality detected",
            "Decompose first, then detect anomalies in residuals",
            "Interpretable and effective",
        ],
        ["Handles seasonal patterns", "Easy to interpret", "Fast"],
        ["Needs clear seasonality", "Fixed threshold"],
    ),
    "Isolation Forest": (
        "ML",
        ["General-purpose anomaly detection", "No assumptions about distribution", "Efficient on large datasets"],
        ["Fast and scalable", "No distribution assumptions", "Robust"],
        ["Less interpretable", "Requires tuning contamination"],
    ),
    "LSTM Autoencoder": (
        "Deep Learning",
        ["Sufficient data for deep learning", "Learns normal patterns automatically", "Captures complex sequences"],
        ["Learns complex patterns", "No manual feature engineering"],
        ["Needs more data", "Computationally expensive"],
    ),
    "K-Means with DTW Distance": (
        "ML",
        ["Time series-aware distance metric", "Groups similar temporal patterns", "Well-established method"],
        ["Works with time series shapes", "Interpretable clusters"],
        ["Need to specify k", "Sensitive to scaling"],
    ),
    "Hierarchical Clustering": (
        "ML",
        [
            "No need to specify number of clusters upfront",
            "Creates dendrogram for visualization",
            "Flexible distance metrics",
        ],
        ["Visual hierarchy", "No k required", "Interpretable"],
        ["Slower on large data", "Hard to update"],
    ),
    "DBSCAN": (
        "ML",
        ["Density-based clustering", "Finds arbitrary shaped clusters", "Handles noise/outliers"],
        ["Finds outliers", "No k needed", "Flexible shapes"],
        ["Parameter sensitive", "Struggles with varying density"],
    ),
}
HYBRID_TEXT = {
    "combo": "SARIMA + XGBoost Ensemble",
    "rationale": "High complexity score (%d/10) suggests combining statistical and ML approaches for better accuracy",
    "approach": "Use SARIMA for trend/seasonality, XGBoost for residuals and non-linear patterns",
}
# One id per algorithm for the names used by rules, trainer and training table.
ALIASES = {
    "SARIMA": ["SARIMA"],
    "ARIMA": ["ARIMA"],
    "Prophet": ["Prophet"],
    "ETS": ["ETS", "Exponential Smoothing", "Exponential Smoothing (ETS)"],
    "XGBoost": ["XGBoost", "XGBoost with Lag Features"],
    "STL_ETS": ["STL_ETS", "STL + ETS (Hybrid)"],
    "ARIMA_ETS_GBDT": ["ARIMA + ETS + GBDT (Hybrid)"],
    "LSTM": ["LSTM (Deep Learning)"],
}


def canonical(name: Column) -> Column:
    chain = F
    for ident, names in ALIASES.items():
        chain = chain.when(name.isin(names), F.lit(ident))
    return chain.otherwise(name)


def _item(name: str, confidence: Column, order: int) -> Column:
    category, reasons, pros, cons = {**FORECASTING_TEXT, **OTHER_TEXT}[name]
    texts = [F.lit(r) if isinstance(r, str) else fmt(r[0], F.col(r[1])) for r in reasons]
    words = lambda values: F.array(*[F.lit(v) for v in values])
    return F.struct(
        (-confidence.cast("double")).alias("sort_by"),
        F.lit(order).alias("order"),
        F.lit(name).alias("name"),
        confidence.cast("double").alias("confidence"),
        F.lit(category).alias("category"),
        F.array(*texts).alias("reasons"),
        words(pros).alias("pros"),
        words(cons).alias("cons"),
    )


def _forecasting() -> list[tuple[Column, str, Column]]:
    n, score = F.col("dataset_size"), F.col("data_complexity_score")
    seasonal, share = F.col("has_seasonality"), F.col("seasonality_strength")
    cap = lambda top, value: F.least(F.lit(float(top)), value.cast("double"))
    return [
        (seasonal & ~F.col("is_stationary") & (n < 5000), "SARIMA", cap(95, 90 + share * 10)),
        (seasonal & (n >= 100), "Prophet", cap(92, 80 + share * 15)),
        (F.col("has_trend") & ~seasonal & (n < 3000), "ARIMA", F.lit(85.0)),
        ((score < 5) & (n < 1000), "Exponential Smoothing (ETS)", F.lit(75.0)),
        ((n > 1000) | (score >= 6), "XGBoost with Lag Features", cap(92, 82 + F.least(score, F.lit(10)) * 1.5)),
        ((n > 5000) & (score >= 7), "LSTM (Deep Learning)", cap(88, 78 + score * 2)),
    ]


def _listed(task: str) -> list[tuple[Column, str, Column]]:
    n, always = F.col("dataset_size"), F.lit(True)
    return {
        "Classification": [
            (always, "Random Forest Classifier", F.lit(85.0)),
            (n > 1000, "LSTM Classifier", F.lit(80.0)),
            (always, "k-NN with DTW", F.lit(75.0)),
        ],
        "Anomaly Detection": [
            (F.col("has_seasonality"), "STL Decomposition + Z-Score", F.lit(88.0)),
            (always, "Isolation Forest", F.lit(85.0)),
            (n > 500, "LSTM Autoencoder", F.lit(82.0)),
        ],
        "Clustering": [
            (always, "K-Means with DTW Distance", F.lit(82.0)),
            (always, "Hierarchical Clustering", F.lit(78.0)),
            (always, "DBSCAN", F.lit(75.0)),
        ],
    }[task]


def _candidates(rules) -> Column:
    """Rules that fire, each with its sort key."""
    return F.array_compact(
        F.array(*[F.when(hit, _item(name, conf, order)) for order, (hit, name, conf) in enumerate(rules)])
    )


def _public(item: Column) -> Column:
    return F.struct(*[item[c].alias(c) for c in ("name", "confidence", "category", "reasons", "pros", "cons")])


def recommend(features: DataFrame, tasks=None) -> DataFrame:
    """One row per series and task: primary, alternatives, hybrid_suggestion.

    Forecasting is sorted by confidence, ties in rule order, and keeps two alternatives; the
    other tasks stay in rule order and keep all. An unknown task gives no primary.
    """
    tasks = [tasks] if isinstance(tasks, str) else list(tasks or ["Forecasting"])
    rows = features.withColumn("task", F.explode(F.array(*[F.lit(t) for t in tasks])))
    rows = rows.withColumn("non_stationary_text", F.when(F.col("is_stationary"), "False").otherwise("True"))
    rows = rows.withColumn("lags_text", list_text(F.slice("recommended_lags", 1, 3)))
    task = F.col("task")
    found = F.when(task == "Forecasting", F.slice(F.sort_array(_candidates(_forecasting())), 1, 3))
    for name in TASKS[1:]:
        found = found.when(task == name, _candidates(_listed(name)))
    rows = rows.withColumn("found", found)
    hybrid = F.when(
        (task == "Forecasting") & (F.col("data_complexity_score") >= 7),
        F.struct(
            F.lit(HYBRID_TEXT["combo"]).alias("combo"),
            F.format_string(HYBRID_TEXT["rationale"], F.col("data_complexity_score")).alias("rationale"),
            F.lit(HYBRID_TEXT["approach"]).alias("approach"),
        ),
    )
    first = F.get("found", F.lit(0))
    return rows.select(
        KEY,
        "task",
        F.when(first.isNotNull(), _public(first)).alias("primary"),
        F.transform(
            F.coalesce(F.slice("found", 2, 100), F.slice(_candidates(_listed("Clustering")), 1, 0)), _public
        ).alias("alternatives"),
        hybrid.alias("hybrid_suggestion"),
    )


def recommendation_rows(recommendations: DataFrame) -> DataFrame:
    """Primary and alternatives as rows, rank 1 first."""
    items = F.array_compact(F.concat(F.array("primary"), "alternatives"))
    return recommendations.select(KEY, "task", F.posexplode(items).alias("pos", "item")).select(
        KEY, "task", (F.col("pos") + 1).alias("rank"), "item.*"
    )


AI_MINIMUM = 0.3


def decide(recommendations: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """Weigh a classifier's pick (series_id, ai_name, ai_confidence) against the rules, 80 to 20.

    Names are compared by their canonical id.
    """
    if predictions is None:
        rows = recommendations.withColumn("ai_name", F.lit(None).cast("string")).withColumn(
            "ai_confidence", F.lit(0.0)
        )
    else:
        rows = recommendations.join(predictions.select(KEY, "ai_name", "ai_confidence"), KEY, "left")
    rows = rows.withColumn("a", F.coalesce("ai_confidence", F.lit(0.0)))
    rows = rows.withColumn("rule_name", F.col("primary.name")).withColumn(
        "r", F.coalesce(F.col("primary.confidence") / 100, F.lit(0.0))
    )
    a, r, ai, rule = F.col("a"), F.col("r"), F.col("ai_name"), F.col("rule_name")
    available = ai.isNotNull() & (a > AI_MINIMUM)
    same = F.coalesce(canonical(ai) == canonical(rule), F.lit(False))
    high, middle = available & (a >= 0.6), available & (a >= 0.4)
    blend = 0.8 * a + 0.2 * r
    case = (
        F.when(high & same, "high_agree")
        .when(high, "high")
        .when(middle & same, "middle_agree")
        .when(middle & (0.8 * a > 0.2 * r), "middle_ai")
        .when(middle, "middle_rule")
        .otherwise("rule")
    )
    rows = rows.withColumn("ai_available", available).withColumn("case", case)
    case = F.col("case")
    confidence = (
        F.when(case == "high_agree", F.least(F.lit(0.95), blend + 0.1))
        .when(case == "high", blend)
        .when(case == "middle_agree", blend + 0.1)
        .when(case == "middle_ai", 0.8 * a)
        .when(case == "middle_rule", 0.5 * a + 0.5 * r)
        .otherwise(r)
    )
    final = F.when(case.isin("middle_rule", "rule"), rule).otherwise(ai)
    pct = a * 100
    reasoning = (
        F.when(
            case.isin("high", "high_agree"),
            F.array(
                fmt(TEXTS["decision_ai_sure"], pct),
                fmt(TEXTS["decision_ai_primary"], ai),
                F.when(case == "high_agree", fmt(TEXTS["decision_rules_agree"], rule)).otherwise(
                    fmt(TEXTS["decision_rules_differ"], rule)
                ),
            ),
        )
        .when(
            case == "middle_agree",
            F.array(
                fmt(TEXTS["decision_both"], pct, ai), F.lit(TEXTS["decision_consensus"])
            ),
        )
        .when(
            case == "middle_ai",
            F.array(
                fmt(TEXTS["decision_ai_weight"], ai, pct),
                F.format_string(TEXTS["decision_rule_second"], F.coalesce(rule, F.lit("None"))),
            ),
        )
        .when(
            case == "middle_rule",
            F.array(
                F.lit(TEXTS["decision_rule_first"]),
                fmt(TEXTS["decision_ai_weak"], ai, pct),
            ),
        )
        .otherwise(
            F.array(
                F.lit(TEXTS["decision_rule_only"]),
                fmt(TEXTS["decision_ai_short"], ai, pct),
            )
        )
    )
    return rows.select(
        KEY,
        "task",
        "primary",
        "alternatives",
        "hybrid_suggestion",
        "ai_name",
        a.alias("ai_confidence"),
        "ai_available",
        "rule_name",
        r.alias("rule_confidence"),
        final.alias("final_name"),
        confidence.alias("final_confidence"),
        F.array_compact(reasoning).alias("reasoning"),
    )


def final_details(decisions: DataFrame) -> DataFrame:
    """Details of the final pick where the rules know it, and the alternatives without it."""
    everything = F.array_compact(F.concat(F.array("primary"), "alternatives"))
    final = canonical(F.col("final_name"))
    return decisions.select(
        KEY,
        "task",
        "final_name",
        F.get(F.filter(everything, lambda x: canonical(x["name"]) == final), F.lit(0)).alias("details"),
        F.filter("alternatives", lambda x: ~canonical(x["name"]).eqNullSafe(final)).alias("other_options"),
    )


def comparison(decisions: DataFrame, trained_on: int | None = None) -> DataFrame:
    """Classifier, rules and final pick side by side; the first two only where present.

    ``trained_on`` is the number of series in the classifier's training set, where it is known.
    """
    basis = TEXTS["comparison_ai_basis"] if trained_on is None else TEXTS["comparison_ai_count"].format(n=trained_on)

    def row(method, name, confidence, weight, basis):
        return F.struct(
            F.lit(method).alias("method"),
            F.coalesce(name, F.lit("N/A")).alias("prediction"),
            confidence.alias("confidence"),
            F.lit(weight).alias("weight"),
            F.lit(basis).alias("basis"),
        )

    rows = F.array(
        F.when(
            F.col("ai_available"),
            row(
                TEXTS["comparison_ai"],
                F.col("ai_name"),
                F.format_string("%.1f%%", F.col("ai_confidence") * 100),
                "80%",
                basis,
            ),
        ),
        F.when(
            F.col("rule_name").isNotNull(),
            row(
                TEXTS["comparison_rules"],
                F.col("rule_name"),
                F.format_string("%.0f%%", F.col("rule_confidence") * 100),
                "20%",
                TEXTS["comparison_rules_basis"],
            ),
        ),
        row(
            TEXTS["comparison_final"],
            F.col("final_name"),
            F.format_string("%.1f%%", F.col("final_confidence") * 100),
            "100%",
            TEXTS["comparison_final_basis"],
        ),
    )
    return decisions.select(KEY, "task", F.inline(F.array_compact(rows)))


def parameter_hints(features: DataFrame) -> DataFrame:
    """Starting orders for ARIMA-type models."""
    return features.select(
        KEY,
        F.least(F.col("pacf_order"), F.lit(3)).alias("p"),
        F.when(F.col("is_stationary"), 0).otherwise(1).alias("d"),
        F.lit(1).alias("q"),
    )
