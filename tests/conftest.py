import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seriesloom.session import BLOCK_ROWS_CONF, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[4]", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def blocks(spark):
    """Set the block size for one test."""

    def use(rows):
        spark.conf.set(BLOCK_ROWS_CONF, str(rows))

    yield use
    spark.conf.unset(BLOCK_ROWS_CONF)


@pytest.fixture
def panel_of(spark):
    """Panel from {series_id: values}; None stays a missing value."""

    def make(series, start="2020-01-01", freq="D"):
        rows = []
        for name, values in series.items():
            stamps = pd.date_range(start, periods=len(values), freq=freq)
            rows += [
                (name, t.to_pydatetime(), i, None if v is None or v != v else float(v))
                for i, (t, v) in enumerate(zip(stamps, values))
            ]
        return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, i long, y double")

    return make


@pytest.fixture(scope="session")
def waves():
    """A trending weekly wave with noise, and a random walk."""
    rng = np.random.default_rng(7)
    t = np.arange(400)
    return {
        "wave": 50 + 0.1 * t + 8 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 1, 400),
        "walk": np.cumsum(rng.normal(0, 1, 400)),
    }


def values_of(df, column="y", key="a"):
    rows = df.where(f"series_id = '{key}'").orderBy("i").select(column).collect()
    return [r[0] for r in rows]
