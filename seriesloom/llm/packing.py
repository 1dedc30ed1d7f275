"""Best-fit packing into sequences of several permitted lengths.

Texts are measured in words; a text longer than the largest capacity is cut into pieces of that
capacity and a rest. Pieces are dealt at random to shards of about SHARD_PIECES pieces, and each
shard packs its pieces, longest first: a piece goes to the open bin with the least room that takes
it. If there is none, a bin is opened, and its size is the one with the least cost per word that it
can be expected to hold, given the words of all shorter pieces still to come; so the permitted
lengths compete for the same supply. At the end each bin shrinks to the smallest permitted length
that holds its contents. The cost of a sequence grows faster than its length (cost).

Defined cases: texts without words get one row of length 0 without a bin; null counts as empty;
pieces of equal length go by row key; repeated rows are packed like any other; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import BLANKS, Scratch, keyed
from seriesloom.session import ship_package

CAPACITIES = (256, 512, 1024, 2048, 4096)
SHARD_PIECES = 50_000


def cost(capacity: int) -> float:
    """Work for a sequence: linear layers, attention, and a constant share."""
    return capacity + capacity * capacity / 8192 + 16


class _Supply:
    """Words in pieces not yet placed, by piece length: a tree of partial sums."""

    def __init__(self, lengths: Sequence[int], most: int):
        self.sums = [0] * (most + 1)
        for x in lengths:
            self.sums[x] += x
        for i in range(1, most + 1):
            j = i + (i & -i)
            if j <= most:
                self.sums[j] += self.sums[i]

    def take(self, length: int) -> None:
        i = length
        while i < len(self.sums):
            self.sums[i] -= length
            i += i & -i

    def up_to(self, length: int) -> int:
        total, i = 0, length
        while i > 0:
            total += self.sums[i]
            i -= i & -i
        return total


def pack_lengths(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every piece, and the capacity of every bin. Lengths are in descending order, none over the largest capacity."""
    sizes = sorted(capacities)
    prices = [cost(c) for c in sizes]
    supply = _Supply(lengths, sizes[-1])
    # bins by room; bit r of open_rooms tells whether some bin has room r
    by_room: dict[int, list[int]] = {}
    open_rooms = 0
    bins, offsets, used, opened = [], [], [], []
    for length in lengths:
        supply.take(length)
        fitting = open_rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            choices = [
                (price / min(size, length + supply.up_to(size - length)), size) for price, size in zip(prices, sizes) if size >= length
            ]
            room, at = min(choices)[1], len(used)
            opened.append(room)
            used.append(0)
        bins.append(at)
        offsets.append(used[at])
        used[at] += length
        room -= length
        if room:
            held = by_room.setdefault(room, [])
            if not held:
                open_rooms |= 1 << room
            held.append(at)
    return bins, offsets, [next(c for c in sizes if c >= n) for n in used]


def word_count(text: Column) -> Column:
    """Number of runs of characters other than white space."""
    gaps = F.regexp_replace(F.trim(text, F.lit(BLANKS)), r"[^ \t\n\x0B\f\r]+", "x")
    return F.length(F.translate(gaps, BLANKS, "")).cast("long")


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES) -> DataFrame:
    """doc_id, piece, piece_start, piece_length, bin_id, bin_capacity, bin_offset: one row per piece."""
    spark = ship_package(docs.sparkSession)
    scratch = Scratch(spark, "packing")
    most = max(capacities)
    rows = keyed(docs).select("doc_id", "kd", "kt", F.monotonically_increasing_id().alias("row"), word_count(F.col("text")).alias("words"))
    measured = scratch.write(rows, "lengths")
    pieces = measured.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("words") / most) - 1))).alias("piece"))
    pieces = pieces.select("doc_id", "kd", "kt", "row", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("words") - F.col("piece") * most).alias("length"))
    shards = max(1, -(-pieces.count() // SHARD_PIECES))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "kd", "kt", "row", "piece"], ascending=[False, True, True, True, True], ignore_index=True)
        full = frame[frame["length"] > 0]
        bins, offsets, sizes = pack_lengths(full["length"].tolist(), capacities)
        out = frame[["doc_id", "piece"]].assign(piece_start=frame["start"], piece_length=frame["length"], bin_id=None, bin_capacity=None, bin_offset=None)
        out.loc[full.index, "bin_id"] = [f"{s}-{b}" for s, b in zip(full["shard"], bins)]
        out["bin_capacity"] = pd.Series([sizes[b] for b in bins], full.index, "Int64").reindex(out.index)
        out["bin_offset"] = pd.Series(offsets, full.index, "Int64").reindex(out.index)
        return out

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int"))
    schema = "doc_id long, piece long, piece_start long, piece_length long, bin_id string, bin_capacity long, bin_offset long"
    return dealt.groupBy("shard").applyInPandas(run, schema)
