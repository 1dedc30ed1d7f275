"""Hard negatives against brute force."""

import math

import numpy as np
import pytest

from seriesloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, shard string, v string, wanted int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA)


def brute(rows, positives=5, negatives=10, span=(30, 90), every=100):
    """rank and ids by sorting all scores; ids must differ between rows."""
    usable = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, v, y in usable:
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j, z) for j, w, z in usable if (j, w, z) != (i, v, y)]
        scored.sort()
        for p, _, _, j, _ in [s for s in scored if s[-1] == y][:positives]:
            fit = [s for s in scored if s[-1] != y and span[0] * -p <= -100 * s[0] <= span[1] * -p][:negatives]
            out |= {(i, j, rank, s[3], -p, -s[0]) for rank, s in enumerate(fit, 1)}
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("dims", [5, 8, 20])
def test_against_brute_force(spark, monkeypatch, dims):
    rng = np.random.default_rng(dims)
    rows = [(i, rng.normal(0, 0.3, dims).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(600)]
    # equal vectors give ties; one label holds a third of the rows
    rows += [(i, rows[7][1], 2) for i in range(600, 900)]
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 100)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 2)
    monkeypatch.setattr(hard_negatives, "CANDIDATE_BLOCK", 16)
    assert found(hard_negatives.mine(vectors(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, -2.0], 1), (1, [1.0, -1.0], 1), (2, [0.5, -0.5], 2), (3, [0.6, -0.4, 9.0], 2), (None, [0.5, -0.5], 2), (4, None, 2), (5, [1.0, None], 2),
        (6, [float("nan"), 1.0], 2), (7, [float("inf"), 1.0], 2), (8, [0.4, -0.4], None), (9, [], 2), (100, [0.0, 0.0], 3), (200, [-1.0, 1.0], 4), (201, [1.0, -1.0], 4),
    ]
    assert found(hard_negatives.mine(vectors(spark, rows))) == brute(rows)
    assert hard_negatives.mine(vectors(spark, [])).collect() == []
    # another row with the anchor's id is a row of its own, and large components saturate
    twins = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (5, [0.5, 0.0], 2), (100, [3e38, 0.0], 7), (101, [3e38, 0.0], 7)]
    rows = hard_negatives.mine(vectors(spark, twins)).collect()
    assert [(r.anchor_id, r.positive_id, r.negative_id) for r in rows] == [(0, 0, 5)] * 2


def test_lookups_equal_products():
    rng = np.random.default_rng(1)
    a, c = rng.integers(-300, 300, (7, 24)), rng.integers(-512, 512, (100, 24))
    tables = hard_negatives.subset_sums(a, np.dtype(np.int64))
    assert (hard_negatives.scores(hard_negatives.bit_planes(c, 10), tables) == a @ c.T).all()
