"""Ordered transforms: imputation, outliers, scaling, differencing, smoothing, step log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.texts import TEXTS
from seriesloom.operators.quantiles import quantiles
from seriesloom.panel import KEY, attach, in_halo, near, own_rows, renumber, with_halo, with_neighbours

# Wording of the step log.
FILL_NAMES = {
    "ffill": "Forward + backward fill",
    "bfill": "Backward + forward fill",
    "interpolate": "Linear interpolation",
    "mean": "Mean imputation",
    "drop": "Row drop",
}
SCALE_LINES = {
    "standard": "Applied StandardScaler (mean 0, std 1).",
    "minmax": "Applied MinMaxScaler (scaled to [0,1]).",
}
LOG_SHIFT = 1e-6


def fill_missing(panel: DataFrame, method: str = "ffill") -> DataFrame:
    if method == "drop":
        return renumber(panel.where(F.col("y").isNotNull()))
    if method == "mean":
        means = panel.groupBy(KEY).agg(F.avg("y").alias("mean"), F.max("i").alias("last_i"))
        return attach(panel, means).withColumn("y", F.coalesce("y", "mean")).drop("mean")
    if method not in ("ffill", "bfill", "interpolate"):
        return panel
    before, after = F.col("prev.v"), F.col("next.v")
    line = before + (after - before) * (F.col("i") - F.col("prev.i")) / (F.col("next.i") - F.col("prev.i"))
    filled = {
        "ffill": F.coalesce(before, after),
        "bfill": F.coalesce(after, before),
        "interpolate": F.when(F.col("y").isNotNull(), F.col("y"))
        .when(before.isNotNull() & after.isNotNull(), line)
        .otherwise(F.coalesce(before, after)),
    }[method]
    return with_neighbours(panel).withColumn("y", filled).drop("prev", "next")


def iqr_bounds(panel: DataFrame, threshold: float) -> DataFrame:
    """Quartile fences per series."""
    spread = threshold * (F.col("q3") - F.col("q1"))
    return quantiles(panel, {"q1": 0.25, "q3": 0.75}).select(
        KEY, "last_i", (F.col("q1") - spread).alias("lower"), (F.col("q3") + spread).alias("upper")
    )


def flag_outliers(panel: DataFrame, method: str = "clip", threshold: float = 3.0) -> DataFrame:
    """Add ``outlier`` and ``repaired``, the value each row takes after treatment."""
    y = F.col("y")
    if method == "clip":
        joined = attach(panel, iqr_bounds(panel, threshold), "left")
        hit = (y < F.col("lower")) | (y > F.col("upper"))
        fixed = F.when(y < F.col("lower"), F.col("lower")).when(y > F.col("upper"), F.col("upper")).otherwise(y)
    elif method == "zscore":
        stats = panel.groupBy(KEY).agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"))
        joined = attach(panel, stats.join(quantiles(panel, {"median": 0.5}), KEY), "left")
        hit = F.abs(F.try_divide(y - F.col("mean"), F.col("sd"))) > threshold
        fixed = F.when(hit, F.col("median")).otherwise(y)
    else:
        return panel.withColumn("outlier", F.lit(False)).withColumn("repaired", y)
    return joined.select(*panel.columns, F.coalesce(hit, F.lit(False)).alias("outlier"), fixed.alias("repaired"))


def treat_outliers(panel: DataFrame, method: str = "clip", threshold: float = 3.0) -> DataFrame:
    if method not in ("clip", "zscore"):
        return panel
    return flag_outliers(panel, method, threshold).withColumn("y", F.col("repaired")).drop("outlier", "repaired")


def log_offset(least):
    return F.when(least <= 0, -least + LOG_SHIFT).otherwise(F.lit(0.0))


def scale(panel: DataFrame, method: str = "none") -> DataFrame:
    if method not in ("standard", "minmax", "log"):
        return panel
    stats = panel.groupBy(KEY).agg(
        F.avg("y").alias("mean"),
        F.stddev_pop("y").alias("sd"),
        F.min("y").alias("least"),
        F.max("y").alias("most"),
        F.max("i").alias("last_i"),
    )
    y = F.col("y")
    # a series without spread scales to 0, a null stays null
    flat = F.when(y.isNotNull(), F.lit(0.0))
    scaled = {
        "standard": F.coalesce(F.try_divide(y - F.col("mean"), F.col("sd")), flat),
        "minmax": F.coalesce(F.try_divide(y - F.col("least"), F.col("most") - F.col("least")), flat),
        "log": F.ln(y + log_offset(F.col("least"))),
    }[method]
    return attach(panel, stats).withColumn("y", scaled).select(*panel.columns)


def difference(panel: DataFrame, order: int = 1) -> DataFrame:
    """Difference ``order`` times, drop rows left without a value and renumber."""
    if order <= 0:
        return panel
    rows = with_halo(panel, back=order)
    for _ in range(order):
        rows = rows.withColumn("y", F.col("y") - F.lag("y").over(in_halo()))
    return renumber(own_rows(rows).where(F.col("y").isNotNull()))


def rolling_mean(panel: DataFrame, window: int, out: str = "y") -> DataFrame:
    """Trailing mean of full windows, null before the first one."""
    frame = near(-(window - 1), 0)
    full = F.count("y").over(frame) == window
    return own_rows(with_halo(panel, back=window - 1).withColumn(out, F.when(full, F.avg("y").over(frame))))


def smooth(panel: DataFrame, window: int | None = None) -> DataFrame:
    """Trailing mean; rows without one take the next value."""
    if not window or window <= 1:
        return panel
    rows = with_neighbours(rolling_mean(panel, window))
    return rows.withColumn("y", F.coalesce("y", F.col("next.v"))).drop("prev", "next")


@dataclass(frozen=True)
class PrepOptions:
    missing: str = "ffill"
    outliers: str = "clip"
    threshold: float = 3.0
    scaling: str = "none"
    differencing: int = 0
    smoothing: int = 1

    @classmethod
    def for_task(cls, task: str, **chosen) -> "PrepOptions":
        """Defaults of a task; differencing serves forecasting only, smoothing anomaly detection only."""
        given = dict(chosen)
        given.setdefault("outliers", "none" if task == "Anomaly Detection" else "clip")
        if task != "Forecasting":
            given["differencing"] = 0
        if task != "Anomaly Detection":
            given["smoothing"] = 1
        return cls(**given)


def _log(counts: DataFrame, step: int, affected, message) -> DataFrame:
    return counts.select(
        KEY, F.lit(step).alias("step"), affected.cast("long").alias("affected"), message.alias("message")
    )


def preprocess(panel: DataFrame, options: PrepOptions = PrepOptions()) -> tuple[DataFrame, DataFrame]:
    """Run the chain and return (processed panel, step log)."""
    o = options
    filled = fill_missing(panel, o.missing)
    flagged = flag_outliers(filled, o.outliers, o.threshold)
    treated = treat_outliers(filled, o.outliers, o.threshold)
    scaled = scale(treated, o.scaling)
    differenced = difference(scaled, o.differencing)
    out = smooth(differenced, o.smoothing)

    counts = panel.groupBy(KEY).agg(F.count("y").alias("known"), F.count_if(F.col("y").isNull()).alias("before"))
    if o.missing == "drop":
        after = F.lit(0)
    elif o.missing in FILL_NAMES:
        # a fill leaves nulls only where a series has no value at all
        after = F.when(F.col("known") > 0, 0).otherwise(F.col("before"))
    else:
        after = F.col("before")
    both = counts.withColumn("after", after.cast("long"))
    name = FILL_NAMES.get(o.missing, "No missing handling")
    lines = [
        _log(
            both,
            1,
            F.col("before") - F.col("after"),
            F.format_string(TEXTS["step_missing"].format(name=name), F.col("before"), F.col("after")),
        )
    ]
    label = {
        "clip": TEXTS["step_clip"].format(threshold=o.threshold),
        "zscore": TEXTS["step_zscore"].format(threshold=o.threshold),
    }.get(o.outliers, "None")
    hits = flagged.groupBy(KEY).agg(F.count_if("outlier").alias("hits"))
    lines.append(
        _log(hits, 2, F.col("hits"), F.format_string(TEXTS["step_outliers"].format(label=label), F.col("hits")))
    )
    sizes = treated.groupBy(KEY).agg(F.count("y").alias("n"), F.min("y").alias("least"))
    if o.scaling == "log":
        text = F.format_string(
            TEXTS["step_log"], log_offset(F.col("least"))
        )
    else:
        text = F.lit(SCALE_LINES.get(o.scaling, TEXTS["step_no_scale"]))
    lines.append(_log(sizes, 3, F.col("n") if o.scaling in ("standard", "minmax", "log") else F.lit(0), text))
    if o.differencing > 0:
        lines.append(
            _log(sizes, 4, F.lit(o.differencing), F.lit(TEXTS["step_difference"].format(differencing=o.differencing)))
        )
    if o.smoothing and o.smoothing > 1:
        text = F.lit(TEXTS["step_smooth"].format(smoothing=o.smoothing))
        lines.append(_log(sizes, 5, F.col("n"), text))
    log = lines[0]
    for line in lines[1:]:
        log = log.unionByName(line)
    return out, log
