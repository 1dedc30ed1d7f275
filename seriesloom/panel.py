"""The canonical panel (series_id, ts, i, y) and block-wise access to it.

``i`` is the 0-based rank of a row in its series. One series may be far longer than a
task can take, so windows never run over a whole series: rows are cut into blocks of
consecutive positions, and a window over (series_id, block) sees the neighbouring rows it
needs as a halo. Reaches without bound go through one summary row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.session import block_rows, written

KEY = "series_id"


def clean_value(col: Column) -> Column:
    """Target as double with NaN read as null."""
    y = col.cast("double")
    return F.when(~F.isnan(y), y)


def index_calendar(df: DataFrame) -> DataFrame:
    """Rank rows that hold at most one row per calendar unit.

    The calendar bounds each window here (87,600 rows for ten years of hours), however
    many raw rows were folded into a unit before.
    """
    order = Window.partitionBy(KEY).orderBy("ts")
    return df.select(KEY, "ts", (F.row_number().over(order) - 1).cast("long").alias("i"), "y")


def index_rows(df: DataFrame) -> DataFrame:
    """Rank raw rows of series of any length.

    A range partitioning on (series_id, ts, y) spreads even a single series over all tasks.
    The sorted rows are written once with their partition and running number, so the offsets
    below are taken from the very rows they are added to.
    """
    ranged = (
        df.select(KEY, "ts", "y")
        .repartitionByRange(KEY, "ts", "y")
        .sortWithinPartitions(KEY, "ts", "y")
        .withColumn("part", F.spark_partition_id())
        .withColumn("seq", F.monotonically_increasing_id())
    )
    rows = written(ranged, "ranked")
    runs = rows.groupBy(KEY, "part").agg(F.min("seq").alias("first_seq"), F.count("*").alias("rows"))
    earlier = Window.partitionBy(KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    return rows.join(starts, [KEY, "part"]).select(
        KEY, "ts", (F.col("seq") - F.col("first_seq") + F.col("before")).alias("i"), "y"
    )


def with_block(df: DataFrame, size: int | None = None) -> DataFrame:
    return df.withColumn("blk", F.expr(f"i div {size or block_rows(df.sparkSession)}"))


def with_halo(df: DataFrame, back: int = 0, ahead: int = 0) -> DataFrame:
    """Give each block copies of the ``back`` rows before it and the ``ahead`` rows after it.

    Column ``w`` is the block a copy serves; only rows near a block edge are copied.
    """
    size = block_rows(df.sparkSession)
    if max(back, ahead) > size:
        return with_reach(df, F.array(F.struct(F.lit(-ahead).alias("lo"), F.lit(back).alias("hi"))))
    blk = F.expr(f"i div {size}")
    pos = F.col("i") % size
    homes = [blk]
    if back:
        homes.append(F.when(pos >= size - back, blk + 1))
    if ahead:
        homes.append(F.when((pos < ahead) & (blk > 0), blk - 1))
    return df.withColumn("w", F.explode(F.array_compact(F.array(*homes))))


def with_reach(df: DataFrame, ranges: Column) -> DataFrame:
    """Give each block copies of the rows that its own rows look back on, however far back that is.

    ``ranges`` is an array of structs (lo, hi), which may differ per series: a row at position i looks at i - hi to
    i - lo; a negative number looks ahead. A narrow range far back costs one copy per row, not a halo that long.
    """
    size = block_rows(df.sparkSession)
    block = lambda distance: F.floor((F.col("i") + distance) / size).cast("long")
    homes = F.flatten(F.transform(ranges, lambda r: F.sequence(block(r["lo"]), block(r["hi"]))))
    return df.withColumn("w", F.explode(F.array_distinct(F.filter(homes, lambda b: b >= 0))))


def own_rows(df: DataFrame) -> DataFrame:
    """Drop the halo copies again."""
    return df.where(F.expr(f"w = i div {block_rows(df.sparkSession)}")).drop("w")


def near(lo: int, hi: int):
    """Window over a block with halo, rows ``lo`` to ``hi`` around the current one."""
    return Window.partitionBy(KEY, "w").orderBy("i").rowsBetween(lo, hi)


def in_halo():
    return Window.partitionBy(KEY, "w").orderBy("i")


def with_neighbours(df: DataFrame, value: str = "y") -> DataFrame:
    """Add ``prev`` and ``next``: struct(i, v) of the nearest non-null value up to and from each row."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("i"), F.col(value).alias("v")))
    rows = with_block(df).withColumn("known", known)
    edges = rows.groupBy(KEY, "blk").agg(F.max("known").alias("last_known"), F.min("known").alias("first_known"))
    # looking ahead runs backwards from the end: a frame that only grows costs one step per row
    blocks, inside = Window.partitionBy(KEY), Window.partitionBy(KEY, "blk")
    before, upto = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)
    edges = edges.select(
        KEY,
        "blk",
        F.last("last_known", True).over(blocks.orderBy("blk").rowsBetween(*before)).alias("carry_prev"),
        F.last("first_known", True).over(blocks.orderBy(F.desc("blk")).rowsBetween(*before)).alias("carry_next"),
    )
    return (
        rows.withColumn("prev", F.last("known", True).over(inside.orderBy("i").rowsBetween(*upto)))
        .withColumn("next", F.last("known", True).over(inside.orderBy(F.desc("i")).rowsBetween(*upto)))
        .join(edges, [KEY, "blk"])
        .withColumn("prev", F.coalesce("prev", "carry_prev"))
        .withColumn("next", F.coalesce("next", "carry_next"))
        .drop("known", "carry_prev", "carry_next", "blk")
    )


def with_running_sum(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over all rows of the series up to and including each row."""
    rows = with_block(df)
    totals = rows.groupBy(KEY, "blk").agg(F.sum(value).alias("block_total"))
    before = Window.partitionBy(KEY).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(KEY, "blk", F.coalesce(F.sum("block_total").over(before), F.lit(0)).alias("carry"))
    inside = Window.partitionBy(KEY, "blk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(totals, [KEY, "blk"])
        .withColumn(out, F.col("inside") + F.col("carry"))
        .drop("inside", "carry", "blk")
    )


def renumber(df: DataFrame) -> DataFrame:
    """Close gaps in ``i`` after rows were filtered out."""
    size = block_rows(df.sparkSession)
    rows = df.withColumn("blk", F.expr(f"i div {size}"))
    counts = rows.groupBy(KEY, "blk").agg(F.count("*").alias("rows"))
    before = Window.partitionBy(KEY).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(KEY, "blk", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(KEY, "blk").orderBy("i")
    return (
        rows.withColumn("inside", F.row_number().over(inside) - 1)
        .join(counts, [KEY, "blk"])
        .withColumn("i", F.col("before") + F.col("inside"))
        .drop("inside", "before", "blk")
    )


def attach(rows: DataFrame, stats: DataFrame, how: str = "inner") -> DataFrame:
    """Join values per series to rows.

    A join on the series alone would bring all rows of one series to one task. The values are
    repeated once per block instead (column ``last_i``, taken from the rows when it is missing,
    says how far a series goes), and the join runs on series and block. The hint keeps the rows themselves from being
    broadcast: millions of them may take less than the threshold in a file, and many times that in memory.
    """
    if "last_i" not in stats.columns:
        stats = stats.join(rows.groupBy(KEY).agg(F.max("i").alias("last_i")), KEY)
    last = F.expr(f"last_i div {block_rows(rows.sparkSession)}").cast("long")
    spread = stats.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("last_i")
    return with_block(rows).join(spread.hint("shuffle_hash"), [KEY, "blk"], how).drop("blk")


def lengths(panel: DataFrame) -> DataFrame:
    return panel.groupBy(KEY).agg(F.count("*").alias("n"))
