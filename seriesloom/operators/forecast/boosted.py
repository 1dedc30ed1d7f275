"""Gradient-boosted trees on lag features, one step ahead with true lags.

One model serves the whole panel. Every series is standardised by its training rows first, so
series of different level share the trees; for a panel of one series this is a model of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.panel import KEY, attach, in_halo, own_rows, with_halo
from seriesloom.session import written

DEFAULT_LAGS = (1, 2, 3, 7, 14)
ROUNDS, RATE, DEPTH, SHARE, SEED = 200, 0.05, 5, 0.9, 42
TASK_ROWS = 65_536  # training rows of a task


def lag_frame(parts: DataFrame, lags: Sequence[int] = DEFAULT_LAGS, ratio: float = 0.8, value: str = "y") -> DataFrame:
    """Rows with all lags present, split again on the shorter frame."""
    top = max(lags)
    rows = with_halo(parts.select(KEY, "ts", "i", "n", F.col(value).alias("y")), back=top)
    rows = own_rows(rows.select("*", *[F.lag("y", k).over(in_halo()).alias(f"lag_{k}") for k in lags]))
    usable = F.greatest(F.col("n") - top, F.lit(0))
    return (
        rows.where(F.col("i") >= top)
        .dropna(subset=["y", *[f"lag_{k}" for k in lags]])
        .withColumn("j", F.col("i") - top)
        .withColumn("is_train", F.col("i") - top < F.floor(usable * F.lit(float(ratio))))
    )


def standardised(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    stats = frame.where("is_train").groupBy(KEY).agg(F.avg("y").alias("centre"), F.stddev_pop("y").alias("spread"), (F.max("n") - 1).alias("last_i"))
    spread = F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0)
    rows = attach(frame, stats).withColumn("spread", spread)
    return rows.select("*", *[((F.col(c) - F.col("centre")) / F.col("spread")).alias(f"z_{c}") for c in columns])


def dealt(rows: DataFrame, columns: Sequence[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """The columns of rows (series_id, i, ..) in as many partitions as their number asks for.

    Every level of every tree is a job over all partitions, so that a small table in many of them pays for little but
    starting tasks. Rows are dealt and ordered by series and position: the trees draw their rows per partition, and so
    draw the same ones whatever the number of shuffle partitions.
    """
    held = written(rows.select(KEY, "i", *columns), "training")
    parts = max(1, -(-held.count() // task_rows))
    return held.repartition(parts, KEY, "i").sortWithinPartitions(KEY, "i")


def train_trees(rows: DataFrame, inputs: Sequence[str], label: str, rounds: int, depth: int):
    assembler = VectorAssembler(inputCols=list(inputs), outputCol="inputs")
    trees = GBTRegressor(
        featuresCol="inputs",
        labelCol=label,
        predictionCol="z_hat",
        maxIter=rounds,
        stepSize=RATE,
        maxDepth=depth,
        subsamplingRate=SHARE,
        featureSubsetStrategy=str(SHARE),
        seed=SEED,
    )
    # every round goes through the rows several times
    ready = assembler.transform(dealt(rows, [*inputs, label])).select("inputs", label).persist()
    model = trees.fit(ready)
    ready.unpersist()
    return assembler, model


def fit_predict(
    parts: DataFrame, lags: Sequence[int] = DEFAULT_LAGS, ratio: float = 0.8, rounds: int = ROUNDS, depth: int = DEPTH
):
    """Return (forecast rows of the test part with y, model)."""
    names = [f"lag_{k}" for k in lags]
    frame = standardised(lag_frame(parts, lags, ratio), ["y", *names])
    assembler, model = train_trees(frame.where("is_train"), [f"z_{c}" for c in names], "z_y", rounds, depth)
    scored = model.transform(assembler.transform(frame.where("not is_train")))
    usable = F.col("n") - max(lags)
    h = F.col("j") - F.floor(usable * F.lit(float(ratio))) + 1
    out = scored.select(
        KEY, "ts", "i", h.alias("h"), "y", (F.col("z_hat") * F.col("spread") + F.col("centre")).alias("yhat")
    )
    return out, model


def importances(model, names: Sequence[str], spark) -> DataFrame:
    """Feature importances of a tree model, largest first."""
    values = model.featureImportances.toArray()
    rows = sorted(((n, float(v)) for n, v in zip(names, values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")
