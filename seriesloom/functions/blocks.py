"""Matrix sums per series, built block by block.

A block of a series (plus halo) becomes one grouped task that returns a short vector; the
vectors of a series add up. The sums run as an ordinary aggregation with map-side combine,
so the work for one long series spreads over its blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.panel import KEY, with_halo, with_reach
from seriesloom.session import block_rows


def tasks_of(df: DataFrame) -> int:
    return 2 * df.sparkSession.sparkContext.defaultParallelism


def by_block(served: DataFrame, run: Callable[[list[pd.DataFrame]], pd.DataFrame], schema: str) -> DataFrame:
    """Apply run to some whole blocks at a time, each a frame of the rows of one (series, w) in the order of i.

    A block costs time whatever its bytes, by whose number small blocks would all meet in a few tasks; so blocks are dealt to
    a number of tasks. One batch is held, and the block that goes on from one batch to the next.
    """

    def whole(batches):
        held = None
        for pdf in itertools.chain(batches, [None]):
            rows = held if pdf is None else pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if rows is None or rows.empty:
                continue
            names, w = rows[KEY].to_numpy(object), rows["w"].to_numpy()
            starts = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (w[1:] != w[:-1])))
            stops = np.append(starts[1:], len(rows))
            if pdf is not None:
                held, starts, stops = rows.iloc[starts[-1] :], starts[:-1], stops[:-1]
            if len(starts):
                yield run([rows.iloc[lo:hi].reset_index(drop=True) for lo, hi in zip(starts, stops)])

    return served.repartition(tasks_of(served), KEY, "w").sortWithinPartitions(KEY, "w", "i").mapInPandas(whole, schema)


def block_vectors(
    df: DataFrame,
    kernel: Callable[[pd.DataFrame, np.ndarray], np.ndarray],
    back: int | Column,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Sum kernel(rows, own) over the blocks of each series.

    ``rows`` are the sorted rows of a block and its halo, ``own`` marks the rows that belong to
    it. All blocks of a series must return vectors of one length. ``keep`` names columns that are
    constant in a series and are passed on. ``back`` is a number of rows, or ranges as with_reach() takes them.
    """
    size = block_rows(df.sparkSession)
    keep = list(keep)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{KEY} string"] + [f"{c} {types[c]}" for c in keep] + ["vec array<double>"])

    def run(frames):
        made = []
        for pdf in frames:
            own = (pdf["i"].to_numpy() // size) == pdf["w"].iloc[0]
            if own.any():
                made.append({KEY: pdf[KEY].iloc[0], **{c: pdf[c].iloc[0] for c in keep}, "vec": kernel(pdf.drop(columns="w"), own)})
        return pd.DataFrame({c: pd.Series([m[c] for m in made], dtype=object) for c in [KEY, *keep, "vec"]})

    served = with_halo(df, back=back) if isinstance(back, int) else with_reach(df, back)
    parts = by_block(served, run, schema)
    return parts.groupBy(KEY, *keep).agg(sum_vectors("vec").alias("vec"))


def sum_vectors(column: str) -> Column:
    """The sum of arrays of one length, element by element, as one aggregate; pandas hands over NaN as null."""
    whole = F.transform(column, lambda v: F.coalesce(v, F.lit(float("nan"))))
    return vector_to_array(Summarizer.sum(array_to_vector(whole)))


def rows_to_pandas(df: DataFrame, finish: Callable[[dict], dict], schema: str) -> DataFrame:
    """Apply a small per-series solve to rows that already hold the summed vectors.

    A solve costs time whatever its bytes, by which all rows would meet in one task; so rows are dealt to a number of tasks.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches):
        for batch in batches:
            made = [finish(row) for row in batch.to_dict("records")]
            # object columns keep a missing array as None
            yield pd.DataFrame({c: pd.Series([m.get(c) for m in made], dtype=object) for c in names})

    return df.repartition(tasks_of(df), KEY).mapInPandas(run, schema)


def chain_blocks(df: DataFrame, keys: list[str], step: Callable[[object, object], tuple[object, dict | None]], schema: str) -> DataFrame:
    """Fold rows that stand for blocks, in the order of blk, from the left: step(state, row) gives the next state and a row or None.

    The state is None at the start of a key. Only the state and one batch are held.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches):
        last, state = object(), None
        for batch in batches:
            made = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != last:
                    last, state = key, None
                state, out = step(state, row)
                if out is not None:
                    made.append(out)
            yield pd.DataFrame({c: pd.Series([m.get(c) for m in made], dtype=object) for c in names})

    return df.repartition(*keys).sortWithinPartitions(*keys, "blk").mapInPandas(run, schema)
