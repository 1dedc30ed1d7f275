"""Texts of findings, cards, decisions and step logs."""

# fixed values: the wording that results must have, in the order of their topics
TEXTS = {
    "trend_found": "Linear regression: significant %s trend (p = %.4f).",
    "trend_none": "Linear regression: no significant linear trend (p = %.4f).",
    "trend_line": "Slope = %.4f, R² = %.3f.",
    "season_variance": "Seasonal variance = %.3f, residual variance = %.3f.",
    "season_failed": "Could not compute decomposition: needs two complete cycles without missing values",
    "season_share": "Seasonality strength ≈ %.1f%%.",
    "season_strong": "Strong repeating seasonal pattern present.",
    "season_moderate": "Moderate seasonal pattern present.",
    "season_weak": "Only weak seasonal pattern detected.",
    "adf_numbers": "ADF test: statistic = %.3f, p = %.4f.",
    "adf_failed": "ADF test failed: too few or constant values",
    "adf_stationary": "ADF suggests the series is stationary (rejects unit root).",
    "adf_root": "ADF suggests the series is non-stationary (fails to reject unit root).",
    "kpss_numbers": "KPSS test: statistic = %.3f, p = %.4f.",
    "kpss_failed": "KPSS test failed: too few or constant values",
    "kpss_stationary": "KPSS suggests the series is stationary.",
    "kpss_root": "KPSS suggests the series is non-stationary.",
    "acf_found": "ACF: significant correlation at lags %s.",
    "acf_none": "ACF: no clearly significant lags.",
    "pacf_order": "PACF: suggests AR order around %d.",
    "summary_no_trend": "The data does not show a clear long‑term upward or downward trend.",
    "summary_strong_trend": "The data has a strong %s trend over time.",
    "summary_moderate_trend": "The data shows a moderate %s trend.",
    "summary_weak_trend": "There is only a weak %s trend.",
    "summary_weekly": " (roughly weekly seasonality).",
    "summary_yearly": " (roughly yearly seasonality for monthly data).",
    "summary_season": "There is a clear seasonal pattern repeating every %d time steps",
    "summary_no_season": "No strong calendar‑based seasonal pattern is detected.",
    "summary_stable": "Overall, the series looks statistically stable over time (stationary).",
    "summary_unstable": "The series is not stationary; applying differencing or detrending will help many models.",
    "card_size": "Size: %d observations",
    "card_frequency": "Frequency: %s",
    "card_missing": "Missing: %.1f%%",
    "card_outliers": "Outliers: %.1f%%",
    "card_trend": "Trend: %s",
    "card_direction": "Direction: %s",
    "card_strength": "Strength: %.2f",
    "card_slope": "Slope: %.4f",
    "card_seasonal": "Seasonal: %s",
    "card_period": "Period: %s",
    "card_stationary": "Stationary: %s",
    "card_adf": "ADF p-value: %.4f",
    "card_no_adf": "ADF: N/A",
    "card_reading": "Interpretation: %s",
    "card_lag1": "Lag-1 ACF: %.3f",
    "card_order": "AR order hint: %d",
    "card_lags": "Key lags: %s",
    "card_grade": "Strength: %s",
    "card_score": "Score: %d/10",
    "card_level": "Level: %s",
    "card_hybrid": "Hybrid: %s",
    "summary_cyclical": "The series does not follow a fixed calendar pattern but moves in irregular waves, which is more like **cyclical** behaviour than standard seasonality.",
    "decision_ai_sure": "AI model has high confidence (%.1f%%)",
    "decision_ai_primary": "Primary recommendation: %s (AI-driven)",
    "decision_rules_agree": "Rule-based system agrees: %s",
    "decision_rules_differ": "Note: Rule-based system suggested %s, but AI has stronger evidence",
    "decision_both": "Both AI (%.1f%%) and rules agree on %s",
    "decision_consensus": "High consensus recommendation",
    "decision_ai_weight": "AI suggestion (%s, %.1f%%) has higher weighted score",
    "decision_rule_second": "Rule-based suggested %s as alternative",
    "decision_rule_first": "Using rule-based recommendation due to low AI confidence",
    "decision_ai_weak": "AI suggested %s but with only %.1f%% confidence",
    "decision_rule_only": "Using rule-based recommendation (AI unavailable or low confidence)",
    "decision_ai_short": "AI prediction (%s) had insufficient confidence (%.1f%%)",
    "comparison_ai": "AI Meta-Model",
    "comparison_ai_basis": "Trained on benchmarked series",
    "comparison_ai_count": "Trained on {n} benchmarked series",
    "comparison_rules": "Rule-Based",
    "comparison_rules_basis": "Statistical tests + heuristics",
    "comparison_final": "Final Hybrid",
    "comparison_final_basis": "Weighted combination",
    "step_missing": "Missing values: %d → %d using [{name}]",
    "step_outliers": "Outliers handled: ~%d adjusted using [{label}]",
    "step_clip": "IQR clipping (±{threshold} IQR)",
    "step_zscore": "Z-score replacement (|z|>{threshold})",
    "step_log": "Applied log-transform (shifted by %.4f to ensure positivity).",
    "step_no_scale": "No scaling/transform applied.",
    "step_difference": "Applied differencing of order {differencing}.",
    "step_smooth": "Applied rolling mean smoothing (window={smoothing}).",
}
