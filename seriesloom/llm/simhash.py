"""SimHash near-dedup with pigeonring filtering.

A text's fingerprint has bit b set if more than half of the hashes of its word shingles have it.
Fingerprints link at MAX_BITS or fewer differing bits. Documents with one fingerprint are one node,
so copies never meet pair by pair.

Candidates come from the pigeonring: cut the 64 bits into SEGMENTS segments in a ring. If two
fingerprints differ in at most MAX_BITS bits, some chain of consecutive segments starts where
every prefix of it stays within its share, floor(length * MAX_BITS / SEGMENTS): here an equal
segment whose next one differs in at most one bit. Each fingerprint is indexed under its five
two-segment keys and looks up each key and its one-bit changes in the second segment; chains
of three and four segments are then checked before the full distance.

Groups of near copies are dense, so pairs inside a group are avoided: fingerprints that are close in
five sorted orders are linked first, and lookups are only made under keys that still hold
fingerprints of more than one component. A pair left out this way is connected already.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like others; a text
with fewer words than a shingle is one shingle; a null doc_id counts as larger than any other, so
a component of only null ids has a null id; repeated rows share a fingerprint; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import Scratch, rows_by_key, salted_left_join, shuffled
from seriesloom.llm.components import connected
from seriesloom.session import ship_package

WORDS = 4
SEED = 42
MAX_BITS = 4
# widths of the ring's segments
SEGMENTS = (13, 13, 13, 13, 12)
NEIGHBOURS = 8
# shingle hashes whose bits are counted at once
_PART = 1 << 15


def fingerprint(text: bytes, width: int = WORDS) -> int:
    """The 64-bit fingerprint of a whole text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], ">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PART):
        part = hashes[at : at + _PART]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """doc_id, kt (hash of id and text) and fp (the fingerprint as a signed long)."""
    number, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), width) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.int64())], ["doc_id", "kt", "fp"])

    return docs.select(number, F.xxhash64(number, text), text.cast("binary")).mapInArrow(run, "doc_id long, kt long, fp long")


def _rotated(fp: Column, by: int) -> Column:
    """The 64 bits turned so that the ring starts `by` bits later."""
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _starts() -> list[int]:
    return [sum(SEGMENTS[:i]) for i in range(len(SEGMENTS))]


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS


def sorted_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints that lie within NEIGHBOURS places in one of the sorted orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(0, np.uint64)
        for batch in batches:
            fps = np.concatenate([last, batch.column(0).to_numpy().view(np.uint64)])
            for lag in range(1, NEIGHBOURS + 1):
                # pairs that end in this batch
                first = max(0, len(last) - lag)
                a, b = fps[first : len(fps) - lag], fps[first + lag :]
                near = np.bitwise_count(a ^ b) <= MAX_BITS
                if near.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[near].view(np.int64)) for x in (a, b)], ["a", "b"])
            last = fps[-NEIGHBOURS:]

    links = None
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for by in _starts():
        ordered = nodes.select("fp").repartitionByRange(parts, _rotated(F.col("fp"), by)).sortWithinPartitions(_rotated(F.col("fp"), by))
        found = ordered.mapInArrow(run, "a long, b long")
        links = found if links is None else links.unionByName(found)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _keys(at: int, fp: Column) -> Column:
    """The two-segment key of the ring starting at segment `at`, with the start in its high bits."""
    first, second = SEGMENTS[at], SEGMENTS[(at + 1) % len(SEGMENTS)]
    key = F.shiftrightunsigned(_rotated(fp, _starts()[at]), 64 - first - second)
    return key.bitwiseOR(F.lit(at << 32).cast("long"))


def _chain(x: Column) -> Column:
    """Whether the differing bits x start a chain at some segment, up to four segments long."""
    fits = F.lit(False)
    for at in range(len(SEGMENTS)):
        turned, width, chain = _rotated(x, _starts()[at]), 0, F.lit(True)
        for length in range(1, len(SEGMENTS)):
            width += SEGMENTS[(at + length - 1) % len(SEGMENTS)]
            chain = chain & (F.bit_count(F.shiftrightunsigned(turned, 64 - width)) <= length * MAX_BITS // len(SEGMENTS))
        fits = fits | chain
    return fits


def pigeonring_links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between fingerprints of different components; nodes has (fp, root)."""
    fp = F.col("fp")
    indexed = nodes.select("fp", "root", F.explode(F.array(*[_keys(i, fp) for i in range(len(SEGMENTS))])).alias("key"))
    looked = []
    for i in range(len(SEGMENTS)):
        second = SEGMENTS[(i + 1) % len(SEGMENTS)]
        # of two fingerprints that differ in one bit there, the one without the bit does the lookup
        unset = [F.getbit(_keys(i, fp), F.lit(b)) == 0 for b in range(second)]
        looked += [_keys(i, fp), *[F.when(x, _keys(i, fp) + F.lit(1 << b)) for b, x in enumerate(unset)]]
    lookups = nodes.select("fp", "root", F.explode(F.array_compact(F.array(*looked))).alias("key"))
    # a key under which only one component is indexed and looked up can't give a new link
    held = indexed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    wanted = scratch.write(shuffled(lookups).join(held, "key").where("low <> root OR high <> root").select("fp", "root", "key"), "lookups")
    pairs = wanted.alias("l").join(shuffled(indexed).alias("r"), F.expr("l.key = r.key AND l.root <> r.root"))
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    near = pairs.where(_chain(x)).where(_close(F.col("l.fp"), F.col("r.fp")))
    return near.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")).distinct()


def group(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """doc_id, kt, fp, component_id (the smallest doc_id reachable) and top (a key of the component), one row per row of docs."""
    spark = ship_package(docs.sparkSession)
    scratch = Scratch(spark, "simhash")
    rows = scratch.write(fingerprints(docs, width), "rows")
    nodes = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    near = scratch.write(sorted_links(nodes), "sorted-links")
    roots = connected(near, scratch, "sorted")
    labelled = scratch.write(
        nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "labelled"
    )
    more = scratch.write(
        pigeonring_links(labelled, scratch).alias("p")
        .join(labelled.alias("x"), F.expr("p.a = x.fp")).join(labelled.alias("y"), F.expr("p.b = y.fp"))
        .select(F.col("x.root").alias("a"), F.col("y.root").alias("b")).distinct(),
        "ring-links",
    )
    joined = connected(more, scratch, "ring")
    final = labelled.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    final = final.select("fp", "least", F.coalesce("top", "root").alias("top"))
    smallest = final.groupBy("top").agg(F.min("least").alias("component_id"))
    members = scratch.write(final.join(smallest, "top").select("fp", "component_id", "top"), "members")
    return salted_left_join(rows, members, ["fp"], F.col("kt"), many=True).select("doc_id", "kt", "fp", "component_id", "top")


def keep_rows(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """One row of docs per component with all its columns: the one with the smallest doc_id, null last."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "kt"))
    stay = group(docs, width).groupBy("top").agg(first.alias("f"))
    # rows with one key repeat id and text: one of them stays
    return rows_by_key(docs, stay.select(F.coalesce("f.doc_id", F.lit(0)).alias("kd"), F.col("f.kt").alias("kt")))
