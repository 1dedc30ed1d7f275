"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics of a text (STATISTICS) are computed once and written as a short array per row. The
cosine features approximate a Gaussian kernel; every partition of labelled rows adds up its share
of the normal equations, Spark sums the shares, and one (FEATURES + 1) square system is solved.
The ridge scores of labelled rows that were kept out of the fit are folded into SCORE_BINS bins and
made monotone; the calibrated score is interpolated between the resulting blocks.

Defined cases: null and empty texts have all-zero statistics and are scored like any other; rows
with a null id are scored and counted as not held out, but never learned from; labels other than 0
and 1 are ignored; repeated labels of a document count once each; without labels of both classes
every score is the mean label, or 0.5 without any; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import Scratch, crc_mod
from seriesloom.session import ship_package

STATISTICS = (
    "log_chars", "log_words", "mean_word", "spread_word", "upper", "digit", "blank", "stop", "mark", "symbol", "other",
    "distinct_words", "top_word", "distinct_triples", "adjacent_equal", "repeated_lines", "log_words_per_line", "all_upper_words",
)
FEATURES = 256
BANDWIDTH = 0.25
RIDGE = 1e-2
SCORE_BINS = 1000
THRESHOLD = 0.3
HELD_OUT = (5, 0)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point below 0x3000: lower or caseless letter, upper, digit, blank, stop, mark, symbol, other."""
    kinds = np.full(0x3001, 7, np.uint8)
    kinds[0x3000] = 0
    for code in range(0x3000):
        kind = unicodedata.category(chr(code))
        if kind == "Lu":
            kinds[code] = 1
        elif kind[0] in "LM":
            kinds[code] = 0
        elif kind[0] == "N":
            kinds[code] = 2
        elif kind[0] == "Z" or chr(code) in "\t\n\x0b\x0c\r":
            kinds[code] = 3
        elif chr(code) in ".,":
            kinds[code] = 4
        elif kind[0] == "P":
            kinds[code] = 6 if chr(code) in "#*%&" else 5
        elif kind[0] == "S":
            kinds[code] = 6
    return kinds


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of a whole text."""
    if not text:
        return [0.0] * len(STATISTICS)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    shares = np.bincount(_classes()[np.minimum(codes, 0x3000)], minlength=8) / len(codes)
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    if not n:
        return [np.log1p(len(codes)), 0.0, 0.0, 0.0, *shares[1:].tolist(), *[0.0] * 7]
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    triples = len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0
    return [
        np.log1p(len(codes)), np.log1p(n), lengths.mean(), lengths.std(), *shares[1:].tolist(),
        len(counts) / n, max(counts.values()) / n, triples, sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(map(str.isupper, words)) / n,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats array<float>, one row per document, in a single pass over the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float32()))], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, stats array<float>")


class Model:
    """Weights of the cosine features and the calibration blocks; a few kilobytes, sent with the tasks."""

    def __init__(self, centre, scale, prior):
        rng = np.random.default_rng(17)
        self.centre, self.scale = centre, scale
        self.directions = rng.normal(0, BANDWIDTH, (len(STATISTICS), FEATURES))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.weights[-1] = prior
        self.knots, self.values = np.array([0.0]), np.array([prior])

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosine features and a constant."""
        x = np.clip((stats - self.centre) / self.scale, -8, 8)
        waves = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / FEATURES)
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.values)


def pool_adjacent(at: np.ndarray, weight: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone blocks of weighted means: their weighted places and their values."""
    blocks: list[list[float]] = []
    for x, w, v in zip(at, weight, value):
        blocks.append([x * w, w, v * w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def _stack(frame: pd.DataFrame) -> np.ndarray:
    return np.array(frame["stats"].tolist(), np.float64).reshape(len(frame), len(STATISTICS))


def fit(rows: DataFrame) -> Model:
    """Fit on rows of (stats, label, calibrate); rows flagged calibrate only shape the calibration."""
    vector = array_to_vector(F.col("stats").cast("array<double>"))
    known = rows.agg(F.avg("label").alias("prior"), F.countDistinct("label").alias("kinds")).first()
    if known.prior is None:
        return Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), 0.5)
    moments = rows.agg(Summarizer.metrics("mean", "std").summary(vector).alias("m")).first().m
    model = Model(moments.mean.toArray(), np.maximum(moments.std.toArray(), 1e-6), known.prior)
    if known.kinds < 2:
        return model

    def share(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for frame in frames:
            x = model.features(_stack(frame))
            total += x.T @ np.column_stack([x, frame["label"].to_numpy(np.float64)])
        yield pd.DataFrame({"i": range(FEATURES + 1), "v": list(total)})

    learned = rows.where("not calibrate").select("stats", "label").mapInPandas(share, "i int, v array<double>")
    summed = learned.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).orderBy("i").collect()
    system = np.array([r.v for r in summed])
    penalty = np.eye(FEATURES + 1) * RIDGE
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(system[:, :-1] + penalty, system[:, -1])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bins = np.rint(np.clip(model.raw(_stack(frame)), -0.5, 1.5) * SCORE_BINS)
            yield pd.DataFrame({"bin": bins.astype("int32"), "label": frame["label"]})

    binned = rows.where("calibrate").select("stats", "label").mapInPandas(place, "bin int, label int")
    folded = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("label").alias("v")).orderBy("bin").toPandas()
    if len(folded):
        model.knots, model.values = pool_adjacent(folded["bin"] / SCORE_BINS, folded["n"], folded["v"])
    return model


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document; labels (doc_id, quality) are read for documents that are not held out.

    Of these, every fourth (crc32 mod 5 is 4) only calibrates.
    """
    spark = ship_package(docs.sparkSession)
    scratch = Scratch(spark, "quality")
    stats = scratch.write(document_statistics(docs), "stats")
    remainder = crc_mod("doc_id", HELD_OUT[0])
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & (remainder != HELD_OUT[1]))
    rows = stats.join(known, "doc_id").select("stats", "label", (remainder == 4).alias("calibrate"))
    model = fit(scratch.write(rows, "rows"))
    scratch.drop("rows")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            score = np.clip(model.score(_stack(frame)), 0, 1)
            yield frame[["doc_id", "held_out"]].assign(score=score, predicted=(score >= THRESHOLD).astype("int32"))

    held = F.coalesce(remainder == HELD_OUT[1], F.lit(False)).alias("held_out")
    return stats.select("doc_id", held, "stats").mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
