"""A family of sorted runs: batches are added as runs of level 0, two runs of one level merge to the next.

A run holds rows (k1, k2, seen, n, top): a 128-bit key, whether an older run had it when the row
came in, how many members it stands for, and the largest id among them; a key once. Runs are bucketed and
sorted by key, so a batch is compared with the runs, and runs are merged, bucket by bucket without
moving them again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import Scratch

KEY = ["k1", "k2"]


def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Merge two runs side by side; each has a key once. A key was seen before if all its rows say so."""
    b = b.withColumnsRenamed({"n": "n2", "top": "top2", "seen": "seen2"})
    seen = F.coalesce("seen", F.lit(True)) & F.coalesce("seen2", F.lit(True))
    count = F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))
    # joined by the bucket key alone: nothing is moved, and a task writes one bucket
    return a.join(b, KEY, "full").select(*KEY, seen.alias("seen"), count.alias("n"), F.greatest("top", "top2").alias("top"))


class SortedRuns:
    def __init__(self, spark: SparkSession, scratch: Scratch):
        self.spark, self.scratch = spark, scratch
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str]] = []

    def add(self, members: DataFrame) -> None:
        """Fold (k1, k2, n, top) by key, mark the keys that older runs hold, and add the run."""
        marked = members.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("top").alias("top")).withColumn("seen", F.lit(False))
        for _, name in self.levels:
            held = self._read(name).where("not seen").select(*KEY, F.lit(True).alias("held"))
            marked = marked.join(held, KEY, "left").withColumn("seen", F.col("seen") | F.col("held").isNotNull()).drop("held")
        self.levels.append((0, self._write(marked)))
        self.scratch.release()
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (level, young), (_, old) = self.levels.pop(), self.levels.pop()
            self.levels.append((level + 1, self._write(_merge(self._read(old), self._read(young)))))
            for name in (young, old):
                self._drop(name)
            self.scratch.release()

    def totals(self) -> DataFrame:
        """k1, k2, n, top over all runs."""
        runs = [self._read(name) for _, name in self.levels]
        total = runs[0] if runs else self.spark.createDataFrame([], "k1 long, k2 long, seen boolean, n long, top long")
        for run in runs[1:]:
            total = _merge(total, run)
        return total.drop("seen")

    def close(self) -> None:
        for _, name in self.levels:
            self._drop(name)
        self.levels = []

    def _read(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        out = rows.select(*KEY, "seen", F.col("n").cast("long").alias("n"), F.col("top").cast("long").alias("top"))
        writer = out.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("compression", "zstd")
        writer.option("path", self.scratch.path(name)).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)
