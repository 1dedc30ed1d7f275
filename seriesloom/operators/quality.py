"""Frequency detection, validation and basic statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.quantiles import quantiles
from seriesloom.panel import KEY, in_halo, own_rows, with_halo

# Upper bound of the median gap in seconds, frequency code, name, seasonal period.
FREQUENCIES = [
    (3_600, "H", "Hourly", 24),
    (86_400, "D", "Daily", 7),
    (7 * 86_400, "W", "Weekly", 52),
    (31 * 86_400, "M", "Monthly", 12),
    (92 * 86_400, "Q", "Quarterly", 4),
    (None, "Y", "Yearly", 1),
]
DEFAULT_PERIOD = 12
FREQUENCY_PERIODS = {code: period for _, code, _, period in FREQUENCIES}


def epoch_seconds(ts):
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def _pick(gap, field: int):
    *bounded, last = FREQUENCIES
    chain = F
    for row in bounded:
        chain = chain.when(gap <= row[0], F.lit(row[field]))
    return chain.otherwise(F.lit(last[field]))


def detect_frequency(panel: DataFrame) -> DataFrame:
    """Median gap between successive rows, mapped to a frequency code; no gap counts as yearly."""
    gap = epoch_seconds(F.col("ts")) - epoch_seconds(F.lag("ts").over(in_halo()))
    gaps = own_rows(with_halo(panel.select(KEY, "ts", "i"), back=1).withColumn("gap", gap))
    medians = quantiles(gaps, {"median_gap": 0.5}, value="gap")
    every = panel.select(KEY).distinct()
    return every.join(medians.drop("last_i"), KEY, "left").select(
        KEY,
        F.col("median_gap").alias("median_gap_seconds"),
        _pick(F.col("median_gap"), 1).alias("frequency"),
        _pick(F.col("median_gap"), 2).alias("frequency_name"),
    )


def seasonal_period(frequency):
    """Seasonal period of a frequency code, 12 when unknown."""
    chain = F
    for _, code, _, period in FREQUENCIES:
        chain = chain.when(frequency == code, F.lit(period))
    return chain.otherwise(F.lit(DEFAULT_PERIOD))


def validate(df: DataFrame, target: str = "y", time: str = "ts", key: str = KEY) -> DataFrame:
    """One row per series with every failed check as a message."""
    numeric = isinstance(df.schema[target].dataType, T.NumericType)
    missing = F.col(target).isNull() | (F.isnan(F.col(target).cast("double")) if numeric else F.lit(False))
    checks = df.groupBy(key).agg(
        F.count("*").alias("n"),
        F.count_if(missing).alias("n_null"),
        # null times count as one more distinct value
        (F.count("*") - F.count_distinct(time) - F.max(F.col(time).isNull().cast("int"))).alias("n_duplicate"),
    )
    null_pct = F.col("n_null") / F.col("n") * 100
    messages = [
        F.when(F.col("n") < 10, F.lit("Dataset too small (minimum 10 observations required)")),
        F.when(null_pct > 50, F.format_string("Too many missing values in target column (%.1f%%)", null_pct)),
        F.lit(None if numeric else "Target column must be numeric"),
        F.when(F.col("n_duplicate") > 0, F.lit("Duplicate timestamps detected")),
    ]
    return checks.select(key, "n", "n_null", "n_duplicate", F.array_compact(F.array(*messages)).alias("errors")).withColumn(
        "is_valid", F.size("errors") == 0
    )


def basic_stats(panel: DataFrame) -> DataFrame:
    y = F.col("y")
    stats = panel.groupBy(KEY).agg(
        F.count("*").alias("count"),
        F.count_if(y.isNull()).alias("missing"),
        (F.count_if(y.isNull()) / F.count("*") * 100).alias("missing_pct"),
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("std"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
        (F.max(y) - F.min(y)).alias("range"),
    )
    return stats.join(quantiles(panel, {"median": 0.5}).drop("last_i"), KEY, "left")
