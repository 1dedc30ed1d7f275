"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Every coordinate has a learning rate of its own, and the L1 term keeps only weights that pay:
the trained model is a short list of places and weights, which goes to all tasks. FTRL is sequential, so
one task learns, PASSES times, from a bounded sample: at most TRAIN_ROWS labelled rows of at most
TRAIN_CHARS characters, those with the smallest hash of their id. Scoring reads every row and the
whole text.

Defined cases: null and empty texts have no feature and get the score of the bias alone; rows with
a null id are scored and never learned from; labels other than 0 and 1 are ignored; without labels
all scores are 0.5 and keep_clean rejects nothing; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import Scratch, crc_mod
from seriesloom.llm.grams import gram_ids, grams
from seriesloom.session import ship_package

BITS = 20
TRAIN_ROWS = 16_000
TRAIN_CHARS = 100_000
PASSES = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 0.1
THRESHOLD = 0.3
HELD_OUT = (4, 2)


class Learner:
    """The FTRL state: gradient sums z and squared-gradient sums n; the last place is the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        short = np.sign(z) * np.minimum(np.abs(z), L1)
        return -(z - short) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + gradient**2


def sampled_labels(labels: DataFrame, bound: int) -> DataFrame:
    """At most `bound` usable labels, those with the smallest hashes."""
    remainder = crc_mod("doc_id", HELD_OUT[0])
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & (remainder != HELD_OUT[1]))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("u", F.shiftright(F.xxhash64("doc_id"), 32))
    share = min(1.0, 1.5 * bound / max(1, known.count()))
    # the hash bound leaves little more than wanted to the final cut
    return known.where(F.col("u") <= F.lit(int(share * (2**32 - 1)) - 2**31)).orderBy("u", "doc_id").limit(bound)


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    """Go through the sample in the order of its hashes, PASSES times; give back the weights that are not zero."""
    size = 1 << BITS
    learner = Learner(size + 1)
    frame = frame.sort_values(["u", "doc_id"])
    rows = [(np.append(ids, size), label) for ids, label in zip(frame["ids"], frame["label"])]
    for _ in range(PASSES):
        for at, label in rows:
            learner.learn(at, label)
    weights = learner.weights(slice(None))
    # the bias goes along even if it is zero
    places = np.append(np.flatnonzero(weights[:size]), size)
    return pd.DataFrame({"place": places.astype("int32"), "weight": weights[places]})


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Places with a weight, their weights, and the bias."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = scratch.write(sampled_labels(labels, TRAIN_ROWS), "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # bounded by TRAIN_ROWS rows of three numbers
    rows = texts.where(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS).join(F.broadcast(known), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([gram_ids(x.as_py(), BITS) for x in batch.column(3)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], ids], ["doc_id", "u", "label", "ids"])

    gathered = rows.select("doc_id", "u", "label", "text").mapInArrow(features, "doc_id long, u long, label int, ids array<int>")
    weights = gathered.withColumn("task", F.lit(0)).groupBy("task").applyInPandas(_fit, "place int, weight double").toPandas().sort_values("place")
    scratch.drop("labels")
    if weights.empty:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0
    return weights["place"].to_numpy()[:-1], weights["weight"].to_numpy(np.float32)[:-1], float(weights["weight"].iloc[-1])


class Scorer:
    """A trained model, ready to score whole texts."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, bias: float):
        self.dense, self.bias = np.zeros(1 << BITS, np.float32), bias
        self.dense[places] = weights
        self.weighted = self.dense != 0

    def score(self, text: str | None) -> float:
        hits = [x[self.weighted[x]] for x in grams(text, BITS)]
        total = self.dense[np.unique(np.concatenate(hits))].sum(dtype=np.float64) if hits else 0.0
        return float(1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30))))


def score_texts(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id and score of every row."""
    spark = ship_package(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            scores = pa.array([scorer.score(x.as_py()) for x in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document: doc_id, held_out, score, predicted."""
    ship_package(docs.sparkSession)
    held = F.coalesce(crc_mod("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(False)).alias("held_out")
    scored = score_texts(docs, train(docs, labels))
    return scored.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns; without labels, all rows."""
    spark = ship_package(docs.sparkSession)
    places, weights, bias = train(docs, labels)
    if not len(places) and bias == 0:
        return docs
    shared = spark.sparkContext.broadcast((places, weights, bias))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            keep = [scorer.score(x.as_py()) < THRESHOLD for x in batch.column(place)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
