"""Anomaly detection on a panel: residual z-scores, isolation forest, reconstruction error."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.decompose import decompose
from seriesloom.operators.prep import scale
from seriesloom.operators.quantiles import quantiles
from seriesloom.panel import KEY, attach, in_halo, near, own_rows, with_block, with_halo
from seriesloom.session import written

TREES, SAMPLE, CONTAMINATION, SEED = 100, 256, 0.05, 42
WINDOW = 7
STEPS, COMPONENTS, DEVIATIONS = 30, 4, 2.0


def residual_scores(panel: DataFrame, period: int | str) -> DataFrame:
    """Decomposition residual of every row with its z-score, sample deviation."""
    parts = decompose(panel, period).where(F.col("resid").isNotNull())
    stats = parts.groupBy(KEY).agg(F.avg("resid").alias("centre"), F.stddev_samp("resid").alias("spread"), F.max("i").alias("last_i"))
    z = F.try_divide(F.col("resid") - F.col("centre"), F.col("spread"))
    return attach(parts, stats).select(KEY, "ts", "i", "y", "resid", z.alias("z"))


def residual_anomalies(panel: DataFrame, period: int | str, threshold: float = 3.0) -> DataFrame:
    return residual_scores(panel, period).where(F.abs("z") > threshold)


def isolation_features(panel: DataFrame, window: int = WINDOW) -> DataFrame:
    """lag_1, rolling mean and rolling sample deviation; rows without full windows drop out."""
    frame = near(-(window - 1), 0)
    rows = own_rows(
        with_halo(panel.select(KEY, "ts", "i", "y"), back=window)
        .withColumn("lag_1", F.lag("y").over(in_halo()))
        .withColumn("seen", F.count("y").over(frame))
        .withColumn("rolling_mean", F.avg("y").over(frame))
        .withColumn("rolling_std", F.stddev_samp("y").over(frame))
    )
    return rows.where(F.col("seen") == window).drop("seen").dropna(subset=["y", "lag_1", "rolling_std"])


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one isolation tree: (node, feature, cut, left, right, path) with leaf feature -1."""
    nodes, queue = [], [(0, np.arange(len(x)), 0)]
    count = 1
    while queue:
        node, rows, depth = queue.pop()
        part = x[rows]
        spread = part.max(axis=0) - part.min(axis=0)
        open_ = np.flatnonzero(spread > 0)
        if depth >= limit or len(rows) <= 1 or open_.size == 0:
            nodes.append((node, -1, 0.0, 0, 0, depth + _average_path(len(rows))))
            continue
        f = int(rng.choice(open_))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        below = part[:, f] < cut
        nodes.append((node, f, cut, count, count + 1, 0.0))
        queue += [(count, rows[below], depth + 1), (count + 1, rows[~below], depth + 1)]
        count += 2
    return nodes


def _average_path(n: int) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def isolation_forest(
    panel: DataFrame, contamination: float = CONTAMINATION, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED
) -> DataFrame:
    """Score every row; the ``contamination`` share with the highest scores of a series is flagged.

    Every series has a forest of its own. Each tree sees at most ``sample`` rows of its series, those
    with the smallest hash for the tree; a bound on the hash leaves about twice as many to be
    ranked. Trees are grown by grouped tasks and scored block by block.
    """
    names = ["lag_1", "rolling_mean", "rolling_std"]
    rows = isolation_features(panel)
    stats = rows.groupBy(KEY).agg(
        *[f(c).alias(f"{c}_{tag}") for c in names for f, tag in ((F.avg, "avg"), (F.stddev_pop, "sd"))],
        F.count("*").alias("n"),
        F.max("i").alias("last_i"),
    )
    z = [F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_avg"), F.col(f"{c}_sd")), F.lit(0.0)).alias(f"z_{c}") for c in names]
    scaled = written(attach(rows, stats).select(*rows.columns, "n", *z), "isolation")
    inputs = [f"z_{c}" for c in names]

    # a hash below the bound leaves 2 x sample + 40 rows per tree on average, all of a short series
    bound = F.least(F.lit(1.0), (2.0 * sample + 40) / F.col("n")) * (1 << 31)
    draw = lambda t: F.pmod(F.xxhash64(KEY, "i", t, F.lit(seed)), F.lit(1 << 31))
    near_rows = scaled.select(KEY, "i", *inputs, F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < bound)).alias("tree"))
    order = Window.partitionBy(KEY, "tree").orderBy("draw", "i")
    drawn = near_rows.withColumn("draw", draw(F.col("tree"))).withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)

    def grow(key, pdf):
        pdf = pdf.sort_values("place")
        rng = np.random.default_rng([seed, int(key[1]), int(pdf["draw"].iloc[0])])
        x = pdf[inputs].to_numpy()
        nodes = _grow(x, rng, max(1, math.ceil(math.log2(max(len(x), 2)))))
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "below", "above", "path"])
        out.insert(0, KEY, key[0])
        out.insert(1, "tree", int(key[1]))
        out["size"] = len(x)
        return out

    schema = f"{KEY} string, tree int, node int, feature int, cut double, below int, above int, path double, size int"
    # at most trees x 2 x sample nodes a series
    grown = written(drawn.groupBy(KEY, "tree").applyInPandas(grow, schema), "trees")
    blocked = with_block(scaled)
    homes = grown.join(blocked.select(F.col(KEY).alias("owner"), F.col("blk").alias("home")).distinct(), F.col(KEY) == F.col("owner")).drop(KEY)

    def score(pdf, nodes):
        x = pdf[inputs].to_numpy()
        total = np.zeros(len(x))
        for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
            feature, cut, below, above, path = (t[c].to_numpy() for c in ("feature", "cut", "below", "above", "path"))
            at = np.zeros(len(x), dtype=int)
            while True:
                f = feature[at]
                inner = np.flatnonzero(f >= 0)
                if inner.size == 0:
                    break
                here = at[inner]
                goes = x[inner, f[inner]] < cut[here]
                at[inner] = np.where(goes, below[here], above[here])
            total += path[at]
        usual = _average_path(int(nodes["size"].max()))
        out = pdf[[KEY, "ts", "i", "y"]].copy()
        out["score"] = 2.0 ** (-total / max(nodes["tree"].nunique(), 1) / max(usual, 1e-12))
        return out

    pairs = blocked.groupBy(KEY, "blk").cogroup(homes.groupBy("owner", "home"))
    scored = written(pairs.applyInPandas(score, f"{KEY} string, ts timestamp_ntz, i long, y double, score double"), "scores")
    cuts = quantiles(scored, {"cut": 1 - contamination}, value="score")
    return attach(scored, cuts).select(
        KEY, "ts", "i", "y", "score", (F.col("score") > F.col("cut")).alias("is_anomaly")
    )


def sliding_windows(panel: DataFrame, steps: int = STEPS) -> DataFrame:
    """The last ``steps`` values of every row that has them."""
    frame = near(-(steps - 1), 0)
    rows = own_rows(
        with_halo(panel.select(KEY, "ts", "i", "y"), back=steps - 1).withColumn("values", F.collect_list("y").over(frame))
    )
    return rows.where(F.size("values") == steps)


def reconstruction_errors(panel: DataFrame, steps: int = STEPS, components: int = COMPONENTS) -> DataFrame:
    """Mean squared error of each window after projection on the leading components."""
    windows = sliding_windows(scale(panel, "standard"), steps)
    vectors = written(windows.select(KEY, "ts", "i", "values"), "windows").withColumn(
        "vector", array_to_vector("values")
    )
    model = PCA(k=components, inputCol="vector", outputCol="reduced").fit(vectors)
    axes = model.pc.toArray()
    coded = model.transform(vectors).withColumn("code", vector_to_array("reduced"))
    # steps x components numbers, written out as a literal array per step
    parts = F.array(
        *[
            F.get("values", F.lit(t)) - sum((F.get("code", F.lit(k)) * float(axes[t, k]) for k in range(components)), F.lit(0.0))
            for t in range(steps)
        ]
    )
    error = F.aggregate(parts, F.lit(0.0), lambda a, e: a + e * e) / steps
    return coded.select(KEY, "ts", "i", error.alias("mse"))


def over_threshold(errors: DataFrame, value: str = "mse", deviations: float = DEVIATIONS) -> DataFrame:
    """Flag rows above mean + deviations x population deviation of their series."""
    cuts = errors.groupBy(KEY).agg((F.avg(value) + deviations * F.stddev_pop(value)).alias("threshold"), F.max("i").alias("last_i"))
    return attach(errors, cuts).withColumn("is_anomaly", F.col(value) > F.col("threshold"))
