"""Gradient-boosted trees on lag slots: slot k of a series holds the value at its own k-th lag.

One set of trees serves the panel, while every series keeps its own lags. A fitted model is two tables, one row per series
and one row per tree node, so it can be saved, loaded and run ahead step by step without the training session.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.forecast import boosted
from seriesloom.panel import KEY, attach, with_reach
from seriesloom.session import block_rows, workspace, written

SLOTS = 5
NAMES = [f"slot_{k}" for k in range(1, SLOTS + 1)]
SEGMENT = 64  # steps that are handed on at once
SERIES, PAST_VALUES = 1024, 2_000_000  # series, and values of their past, that are run ahead at once


@dataclass
class TreeModel:
    """``params``: series_id, status, error, n_train, lags, centre, spread, tail; ``trees``: tree, node, feature,
    threshold, low, high, value, at most ROUNDS * 2^(DEPTH + 1) rows."""

    params: DataFrame
    trees: DataFrame

    def save(self, path: str) -> None:
        self.params.write.mode("overwrite").parquet(f"{path}/params")
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")

    @classmethod
    def load(cls, spark, path: str) -> "TreeModel":
        return cls(spark.read.parquet(f"{path}/params"), spark.read.parquet(f"{path}/trees"))


def own_lags(parts: DataFrame, lags: DataFrame) -> DataFrame:
    """One row per series: its first SLOTS lags, the last one repeated in empty slots; lag 1 for a series without any.

    ``lags`` has series_id and recommended_lags; entries below 1 are left out.
    """
    given = F.filter(F.coalesce("recommended_lags", F.array().cast("array<int>")), lambda k: k >= 1)
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.coalesce(F.get("given", k), F.try_element_at("given", F.lit(-1)), F.lit(1))
    )
    every = parts.groupBy(KEY).agg(F.max("i").alias("last_i"))
    return (
        every.join(lags.select(KEY, given.cast("array<int>").alias("given")), KEY, "left")
        .withColumn("lags", filled).withColumn("top", F.array_max("lags")).drop("given")
    )


def slot_frame(parts: DataFrame, lags: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Rows that have a value and all their slots, split again on the frame that is left.

    Each block of a series gets the rows at just the distances of the series' lags, so a lag may be longer than a block.
    """
    size = block_rows(parts.sparkSession)
    rows = attach(parts.select(KEY, "ts", "i", "n", "y"), own_lags(parts, lags))
    ranges = F.transform(
        F.concat(F.array(F.lit(0)), F.array_distinct("lags")), lambda k: F.struct(k.alias("lo"), k.alias("hi"))
    )
    served = with_reach(rows, ranges)
    schema = f"{KEY} string, ts timestamp_ntz, i long, n long, y double, top int, " + ", ".join(f"{c} double" for c in NAMES)

    def pick(key, pdf):
        pdf = pdf.sort_values("i", ignore_index=True)
        at, y = pdf["i"].to_numpy(), pdf["y"].to_numpy(float)
        out = pdf[at // size == key[1]][[KEY, "ts", "i", "n", "y", "top"]].reset_index(drop=True)
        for name, lag in zip(NAMES, pdf["lags"].iloc[0]):
            wanted = out["i"].to_numpy() - lag
            place = np.minimum(np.searchsorted(at, wanted), len(at) - 1)
            out[name] = np.where(at[place] == wanted, y[place], np.nan)
        return out

    usable = F.greatest(F.col("n") - F.col("top"), F.lit(0))
    return (
        served.groupBy(KEY, "w").applyInPandas(pick, schema)
        .where(F.col("i") >= F.col("top")).dropna(subset=["y", *NAMES])
        .withColumn("j", F.col("i") - F.col("top"))
        .withColumn("is_train", F.col("j") < F.floor(usable * F.lit(float(ratio))))
    )


def _nodes(model, spark) -> DataFrame:
    """The nodes of a tree ensemble as rows, values weighted, as the model writes them itself."""
    path = f"{workspace(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    node = lambda c: F.col(f"nodeData.{c}")
    leaf = node("leftChild") < 0
    weights = F.array(*[F.lit(float(w)) for w in model.treeWeights])
    return data.select(
        F.col("treeID").alias("tree"),
        node("id").alias("node"),
        F.greatest(node("split.featureIndex"), F.lit(0)).alias("feature"),
        F.when(leaf, 0.0).otherwise(F.get(node("split.leftCategoriesOrThreshold"), F.lit(0))).alias("threshold"),
        # a leaf leads to itself
        F.when(leaf, node("id")).otherwise(node("leftChild")).alias("low"),
        F.when(leaf, node("id")).otherwise(node("rightChild")).alias("high"),
        (node("prediction") * F.get(weights, F.col("treeID"))).alias("value"),
    )


def fit(
    parts: DataFrame, lags: DataFrame, ratio: float = 0.8, rounds: int = boosted.ROUNDS, depth: int = boosted.DEPTH
) -> tuple[TreeModel, DataFrame]:
    """Return the model and its one-step forecasts of the rows after training, made with true values in the slots.

    A series with too few rows for its lags, or without a value in the last rows it is run ahead from, has status failed.
    """
    frame = written(boosted.standardised(slot_frame(parts, lags, ratio), ["y", *NAMES]), "slots")
    inputs = [f"z_{c}" for c in NAMES]
    assembler, trees = boosted.train_trees(frame.where("is_train"), inputs, "z_y", rounds, depth)
    usable = F.greatest(F.col("n") - F.col("top"), F.lit(0))
    end = F.col("top") + F.floor(usable * F.lit(float(ratio)))
    scored = trees.transform(assembler.transform(frame.where("not is_train")))
    ahead = scored.select(
        KEY, "ts", "i", (F.col("i") - end + 1).alias("h"), "y", (F.col("z_hat") * F.col("spread") + F.col("centre")).alias("yhat")
    )

    learned = frame.where("is_train").groupBy(KEY).agg(F.first("centre").alias("centre"), F.first("spread").alias("spread"))
    sizes = parts.select(KEY, "n").distinct().join(own_lags(parts, lags), KEY).withColumn("n_train", end)
    last = attach(parts.select(KEY, "i", "y"), sizes).where("i >= n_train - top and i < n_train")
    tails = last.where("y is not null").groupBy(KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda s: s["y"]).alias("tail")
    )
    short, holes = F.col("centre").isNull(), F.coalesce(F.size("tail"), F.lit(0)) < F.col("top")
    error = F.when(short, "too few rows for the lags").when(holes, "missing values at the end of training")
    params = sizes.join(learned, KEY, "left").join(tails, KEY, "left").select(
        KEY, F.when(error.isNull(), "success").otherwise("failed").alias("status"), error.alias("error"),
        "n_train", "lags", "centre", "spread", "tail",
    )
    spark = parts.sparkSession
    return TreeModel(written(params, "params"), written(_nodes(trees, spark), "trees")), ahead


def _forest(trees: pd.DataFrame):
    """The sum of the trees' values for rows of inputs, all trees at once."""
    shape = (int(trees["tree"].max()) + 1, int(trees["node"].max()) + 1)
    at = (trees["tree"].to_numpy(), trees["node"].to_numpy())
    table = {}
    for name, kind in (("feature", int), ("threshold", float), ("low", int), ("high", int), ("value", float)):
        table[name] = np.zeros(shape, kind)
        table[name][at] = trees[name].to_numpy()
    every = np.arange(shape[0])

    def value(x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), shape[0]), int)
        while True:
            left = np.take_along_axis(x, table["feature"][every, node], axis=1) <= table["threshold"][every, node]
            then = np.where(left, table["low"][every, node], table["high"][every, node])
            if (then == node).all():
                return table["value"][every, node].sum(axis=1)
            node = then

    return value


def predict(model: TreeModel, future: DataFrame) -> DataFrame:
    """Forecasts of the rows (series_id, ts, i, h), h steps after training: a forecast fills the slots of later steps."""
    trees = model.trees.toPandas()
    steps = future.groupBy(KEY).agg(F.max("h").alias("steps"))
    known = model.params.where("status = 'success'").select(KEY, "lags", "centre", "spread", "tail").join(steps, KEY)

    def run(value, pdf):
        lags = np.stack(pdf["lags"].to_numpy()).astype(int)
        centre, spread = pdf["centre"].to_numpy(float), pdf["spread"].to_numpy(float)
        top, last = int(lags.max()), int(pdf["steps"].max())
        # standardised past of every series, its newest value at the right
        past = np.zeros((len(pdf), top))
        for r, tail in enumerate(pdf["tail"]):
            past[r, top - len(tail) :] = (np.asarray(tail, float) - centre[r]) / spread[r]
        for lo in range(0, last, SEGMENT):
            count = min(SEGMENT, last - lo)
            past = np.hstack([past[:, -top:], np.zeros((len(pdf), count))])
            for step in range(count):
                past[:, top + step] = value(np.take_along_axis(past, top + step - lags, axis=1))
            h = np.tile(np.arange(lo + 1, lo + count + 1), len(pdf))
            made = (past[:, top:] * spread[:, None] + centre[:, None]).ravel()
            rows = pd.DataFrame({KEY: np.repeat(pdf[KEY].to_numpy(object), count), "h": h, "yhat": made})
            yield rows[h <= np.repeat(pdf["steps"].to_numpy(), count)]

    def ahead(batches):
        value = _forest(trees)
        for pdf in batches:
            longest = max((len(tail) for tail in pdf["tail"]), default=0)
            width = max(1, min(SERIES, PAST_VALUES // (longest + SEGMENT)))
            for lo in range(0, len(pdf), width):
                yield from run(value, pdf.iloc[lo : lo + width])

    made = known.mapInPandas(ahead, f"{KEY} string, h long, yhat double")
    return future.select(KEY, "ts", "i", F.col("h").cast("long").alias("h")).join(made, [KEY, "h"]).select(KEY, "ts", "i", "h", "yhat")
