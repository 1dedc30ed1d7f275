"""Hard-negative mining with Four-Russians scoring.

Components are scaled to integers. A candidate keeps them as bit planes: plane b holds bit b of all
components in two's complement, eight dimensions to a byte. An anchor has one table per group of
eight dimensions with the sums of all 256 subsets of its components there. The sum of an anchor's
components that plane b selects is then one lookup per byte, and the planes' sums, shifted and
added, are the full exact inner product; no product is formed per pair.

Candidates are dealt to shards of at most SHARD_ROWS rows by a hash of the row. A task holds the planes of
one shard and lets all anchors stream past in blocks, so its memory grows neither with the table nor
with the anchors. Two passes: the first finds each anchor's best rows of its own label, the second
the best rows of other labels in the score range of each positive. Each shard gives its own best
few; ranking those gives the best of all.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; a
shorter vector counts as padded with zeros; scaled components saturate at +-2^24; a null vec_id
orders behind all others and is no anchor; rows that repeat a vec_id are rows of their own; an
anchor without positives, and a positive without rows in its range, give no rows; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import Scratch
from seriesloom.session import ship_package

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
# a negative's score in hundredths of the positive's
RANGE = (30, 90)
ANCHOR_EVERY = 100
SHARD_ROWS = 1 << 15
# anchors and candidates scored at once
ANCHOR_BLOCK = 128
CANDIDATE_BLOCK = 2048
SATURATE = 1 << 24
_BITS = (np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1
_LAST = np.iinfo(np.int64).max


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v (integer components) of the rows that take part."""
    x = F.col("embedding")
    usable = F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    bounded = F.transform(x, lambda e: F.greatest(F.least(F.floor(e.cast("double") * SCALE), F.lit(SATURATE)), F.lit(-SATURATE)).cast("int"))
    # a floor outside the range of long would fail before it could saturate
    limit = float(SATURATE // SCALE)
    clipped = F.transform(x, lambda e: F.greatest(F.least(e.cast("double"), F.lit(limit)), F.lit(-limit)))
    rows = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), clipped.alias("embedding"))
    return rows.select("vec_id", "label", bounded.alias("v"))


def bit_planes(x: np.ndarray, width: int) -> np.ndarray:
    """(width, groups, rows) bytes: bit b of eight neighbouring components of a row."""
    return np.stack([np.packbits((x >> b) & 1, axis=1).T for b in range(width)])


def subset_sums(anchors: np.ndarray, wide: np.dtype) -> np.ndarray:
    """(groups, 256, anchors): sums of the components that a byte's bits select."""
    parts = anchors.reshape(len(anchors), -1, 8).astype(np.int64)
    return np.ascontiguousarray(np.einsum("sj,agj->gsa", _BITS, parts).astype(wide))


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(anchors, rows) exact inner products from lookups, shifts and additions."""
    width, groups, n = planes.shape
    out = np.empty((tables.shape[2], n), tables.dtype)
    for at in range(0, n, CANDIDATE_BLOCK):
        part = planes[:, :, at : at + CANDIDATE_BLOCK]
        total = None
        for b in range(width - 1, -1, -1):
            found = tables[0].take(part[b, 0], axis=0)
            for g in range(1, groups):
                found += tables[g].take(part[b, g], axis=0)
            # the highest plane holds the sign
            total = -found if total is None else (total << 1) + found
        out[:, at : at + CANDIDATE_BLOCK] = total.T
    return out


class Shard:
    """The candidates of one shard, in the order in which ties are broken."""

    def __init__(self, batches: list[pa.Table], width: int, dims: int):
        rows = pa.concat_tables(batches).combine_chunks()
        ids = rows["vec_id"].to_numpy(zero_copy_only=False) if not rows["vec_id"].null_count else rows["vec_id"].fill_null(_LAST).to_numpy()
        order = np.lexsort([rows["row"].to_numpy(), ids, rows["vec_id"].is_null().to_numpy()])
        self.ids = rows["vec_id"].take(pa.array(order))
        self.row, self.label = rows["row"].to_numpy()[order], rows["label"].to_numpy()[order]
        self.planes = bit_planes(_matrix(rows, dims)[order], width)
        self.places = {x: np.flatnonzero(self.label == x) for x in np.unique(self.label).tolist()}


def _matrix(rows: pa.Table, dims: int) -> np.ndarray:
    flat = rows["v"].combine_chunks().flatten().to_numpy()
    return flat.reshape(rows.num_rows, dims)


def best(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values, ties by place."""
    if len(s) > k:
        bound = np.partition(s, len(s) - k)[len(s) - k]
        at = np.flatnonzero(s >= bound)
        return at[np.argsort(-s[at], kind="stable")][:k]
    return np.argsort(-s, kind="stable")


def _found(shard: Shard, parts: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows (anchor_row, place, cand_row, cand_id, score) from (anchor row, positive's place, candidates, scores)."""
    at = np.concatenate([p[2] for p in parts])
    sizes = [len(p[2]) for p in parts]
    columns = [
        pa.array(np.repeat(np.array([p[0] for p in parts], np.int64), sizes)),
        pa.array(np.repeat(np.array([p[1] for p in parts], np.int32), sizes)),
        pa.array(shard.row[at]),
        shard.ids.take(pa.array(at)).combine_chunks(),
        pa.array(np.concatenate([p[3] for p in parts]).astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(columns, FOUND_NAMES)


FOUND = "anchor_row long, place int, cand_row long, cand_id long, score long"
FOUND_NAMES = ["anchor_row", "place", "cand_row", "cand_id", "score"]


def _positives(shard: Shard, block: pa.Table, x: np.ndarray, wide: np.dtype, k: int) -> Iterator[pa.RecordBatch]:
    labels, rows = block["label"].to_numpy(), block["row"].to_numpy()
    for label in np.unique(labels).tolist():
        places = shard.places.get(label)
        if places is None:
            continue
        own = np.flatnonzero(labels == label)
        parts = []
        for a, s in zip(own, scores(shard.planes[:, :, places], subset_sums(x[own], wide))):
            others = shard.row[places] != rows[a]
            at = best(s[others], k)
            parts.append((rows[a], 0, places[others][at], s[others][at]))
        yield _found(shard, parts)


def _negatives(shard: Shard, block: pa.Table, x: np.ndarray, wide: np.dtype, k: int, span: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    labels, rows, wanted = block["label"].to_numpy(), block["row"].to_numpy(), block["wanted"].to_pylist()
    parts = []
    for a, s in enumerate(scores(shard.planes, subset_sums(x, wide))):
        # 100 * score >= low * positive, and 100 * score <= high * positive
        bounds = [(-(-span[0] * p // 100), span[1] * p // 100) for p in wanted[a]]
        least, most = min(b[0] for b in bounds), max(b[1] for b in bounds)
        at = np.flatnonzero((s >= least) & (s <= most) & (shard.label != labels[a]))
        at = at[np.argsort(-s[at], kind="stable")]
        falling = -s[at].astype(np.int64)
        for place, (low, high) in enumerate(bounds):
            first, last = np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -low, "right")
            if first < last:
                picked = at[first : min(last, first + k)]
                parts.append((rows[a], place, picked, s[picked]))
    if parts:
        yield _found(shard, parts)


def _meet(candidates: DataFrame, anchors: DataFrame, shards: int, kernel, width: int, dims: int) -> DataFrame:
    """Let all anchors pass each shard of candidates; anchors come behind the candidates of their shard."""
    wide = np.dtype(np.int32 if 2 * (width - 1) + int(dims).bit_length() < 31 else np.int64)
    columns = ["shard", "side", "row", "vec_id", "label", "v", "wanted"]
    held = candidates.withColumns({"shard": F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"), "side": F.lit(0), "wanted": F.lit(None).cast("array<long>")})
    passing = anchors.withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "side": F.lit(1)})
    both = held.select(*columns).unionByName(passing.select(*columns))
    dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", "side", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, gathered, shard = -1, [], None
        for batch in batches:
            for piece, side in _pieces(batch):
                if piece["shard"][0].as_py() != number:
                    number, gathered, shard = piece["shard"][0].as_py(), [], None
                if side == 0:
                    gathered.append(piece)
                elif gathered:
                    shard = shard or Shard(gathered, width, dims)
                    for at in range(0, piece.num_rows, ANCHOR_BLOCK):
                        block = piece.slice(at, ANCHOR_BLOCK).combine_chunks()
                        yield from kernel(shard, block, _matrix(block, dims), wide)

    return dealt.mapInArrow(run, FOUND)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.Table, int]]:
    """Runs of rows of one shard and side."""
    table = pa.Table.from_batches([batch])
    key = table["shard"].to_numpy().astype(np.int64) * 2 + table["side"].to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield table.slice(a, b - a).combine_chunks(), int(key[a] & 1)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows per key: higher scores, then smaller ids."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("cand_id"), "cand_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, span: tuple[int, int] = RANGE, every: int = ANCHOR_EVERY
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for all rows of (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by `every`.
    """
    spark = ship_package(vectors.sparkSession)
    scratch = Scratch(spark, "negatives")
    rows = scratch.write(scaled(vectors).withColumn("row", F.monotonically_increasing_id()), "rows")
    least, most = F.min(F.array_min("v")), F.max(F.array_max("v"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), least.alias("least"), most.alias("most")).first()
    dims = max(8, -(-(size.dims or 0) // 8) * 8)
    # bits of two's complement
    width = 1 + max((size.most or 0).bit_length(), (-(size.least or 0) - 1).bit_length() if (size.least or 0) < 0 else 0)
    padded = rows.withColumn("v", F.slice(F.concat("v", F.array_repeat(F.lit(0), dims)), 1, dims))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size.n // SHARD_ROWS))
    anchors = padded.where(F.col("vec_id") % every == 0)
    near = _meet(
        padded, anchors.withColumn("wanted", F.lit(None).cast("array<long>")), shards,
        lambda shard, block, x, wide: _positives(shard, block, x, wide, positives), width, dims,
    )
    chosen = scratch.write(_first(near, ["anchor_row"], positives).select("anchor_row", (F.col("rank") - 1).alias("place"), "cand_id", "score"), "positives")
    # at most `positives` scores per anchor
    scored = chosen.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("s"))
    wanted = scored.select(F.col("anchor_row").alias("row"), F.transform("s", lambda e: e["score"]).alias("wanted"))
    found = _meet(padded, anchors.join(wanted, "row"), shards, lambda shard, block, x, wide: _negatives(shard, block, x, wide, negatives, span), width, dims)
    picked = scratch.write(_first(found, ["anchor_row", "place"], negatives), "picked")
    names = rows.where(F.col("vec_id") % every == 0).select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    pairs = chosen.select("anchor_row", "place", F.col("cand_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = picked.join(pairs, ["anchor_row", "place"]).join(names, "anchor_row")
    return named.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("cand_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
