"""From raw rows to features: validate, prepare, preprocess, profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.prep import PrepOptions, preprocess
from seriesloom.operators.profile import profile
from seriesloom.operators.quality import detect_frequency, validate
from seriesloom.panel import KEY, attach
from seriesloom.session import written


@dataclass(frozen=True)
class Analysis:
    checks: DataFrame
    original: DataFrame
    processed: DataFrame
    log: DataFrame
    frequencies: DataFrame
    features: DataFrame


def analyze(panel: DataFrame, options: PrepOptions = PrepOptions(), adf_max_lag: int | None = None) -> Analysis:
    """Series that fail a check are left out of everything but ``checks``.

    Frequency comes from the raw rows, features from the processed ones. The processed panel is
    written once, since every part of the profile reads it.
    """
    checks = validate(panel)
    valid = attach(panel, checks.where("is_valid").select(KEY), "left_semi")
    processed, log = preprocess(valid, options)
    processed = written(processed, "processed")
    frequencies = written(detect_frequency(valid), "frequencies")
    return Analysis(checks, valid, processed, log, frequencies, profile(processed, frequencies, adf_max_lag))
