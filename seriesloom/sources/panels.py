"""Panels from fact tables and raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.panel import KEY, clean_value, index_calendar, index_rows

# units coarse enough for the calendar to bound a series
COARSE = ("hour", "day", "week", "month", "quarter", "year")
FOLDS = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def build_panel(df: DataFrame, key, ts, value, unit: str, how: str = "sum") -> DataFrame:
    """One series per key, one row per calendar unit; raw rows fold map-side before the shuffle.

    Units below the hour can give series of any length and are ranked like raw rows.
    """
    slot = F.date_trunc(unit, _col(ts)).cast("timestamp_ntz")
    folded = (
        df.select(_col(key).cast("string").alias(KEY), slot.alias("ts"), clean_value(_col(value)).alias("y"))
        .where(F.col(KEY).isNotNull() & F.col("ts").isNotNull())
        .groupBy(KEY, "ts")
        .agg(FOLDS[how]("y").cast("double").alias("y"))
    )
    return index_calendar(folded) if unit in COARSE else index_rows(folded)


def densify(panel: DataFrame, unit: str) -> DataFrame:
    """Add a null row for every calendar unit a series skips between its first and last row."""
    if unit not in COARSE:
        raise ValueError(f"densify works on {', '.join(COARSE)}")
    spans = panel.groupBy(KEY).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    grid = spans.select(KEY, F.explode(F.expr(f"sequence(lo, hi, interval 1 {unit})")).alias("ts"))
    return index_calendar(grid.join(panel.select(KEY, "ts", "y"), [KEY, "ts"], "left"))


def prepare(df: DataFrame, ts, value, key=None) -> DataFrame:
    """Raw rows to a panel: parse the time, order each series, keep gaps in the target as null.

    Filling is a separate step so that the share of missing values can be measured first.
    """
    series = _col(key).cast("string") if key is not None else F.lit("series")
    rows = df.select(
        series.alias(KEY), _col(ts).cast("timestamp_ntz").alias("ts"), clean_value(_col(value)).alias("y")
    ).where(F.col("ts").isNotNull())
    return index_rows(rows)


def from_vectors(df: DataFrame, key, values) -> DataFrame:
    """Each array as a short daily series."""
    rows = df.select(_col(key).cast("string").alias(KEY), F.posexplode(_col(values)).alias("pos", "v"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("pos")).cast("timestamp_ntz")
    return rows.select(KEY, day.alias("ts"), F.col("pos").cast("long").alias("i"), clean_value(F.col("v")).alias("y"))
