"""Suffix-array dedup: a logarithmic family of suffix arrays finds strings of LENGTH bytes that repeat.

A suffix array of all positions would be many times the text, so the arrays are sparse. Every
window of LENGTH bytes is filed under the smallest hash of its GRAM-byte substrings: equal windows
have equal smallest hashes, and neighbouring windows share one, so a text falls into segments of
consecutive windows with one anchor. An array holds one entry per distinct pair (anchor hash,
hash of all bytes that the segment's windows cover), ordered by it, with the number of places.

Documents arrive in batches. A batch's array is merge-scanned against the arrays of older levels,
which tells entries found before from new ones, and arrays of equal level merge to the next. Then
- an entry with two places or more: every window of the segment repeats;
- an anchor with two entries or more: where such segments differ, some windows may still be
  equal. One place per entry is compared with the others, first in parts of PART windows, then
  window by window where parts have the same common bytes and still differ.
Both look at all places, so the result is that of comparing all windows with each other.

Removed are all bytes covered by a window that starts anywhere else, in the same row or another;
windows never cross rows. Windows are compared by two 64-bit hashes (anchor and window). Defined
cases: null counts as empty; texts under LENGTH bytes lose nothing; rows with a null id and rows
that repeat an id are rows of their own; extra columns are ignored; an empty table gives an empty
result. Texts of any length are scanned in slices.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.common import Scratch
from seriesloom.llm.grams import mix, polynomial, substring_hashes
from seriesloom.llm.runs import SortedRuns
from seriesloom.session import ship_package

LENGTH = 200
GRAM = 64
BATCHES = 2
# neighbouring windows that are compared together before they are compared one by one
PART = 16
# windows per slice of a text
SLICE = 1 << 19


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` neighbours."""
    size, out = 1, values
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    count = len(values) - width + 1
    return np.minimum(out[:count], out[width - size : width - size + count])


def _slices(text: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first window, bytes, prefix sums) of the slices of a text."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data) - LENGTH + 1, SLICE):
        part = data[at : at + SLICE + LENGTH - 1]
        yield at, part, polynomial(part)


def segments(text: bytes) -> list[np.ndarray]:
    """Anchor hash, content hash, first window and number of windows of every segment, as four arrays."""
    found = []
    for at, part, sums in _slices(text):
        grams = substring_hashes(sums, np.arange(len(part) - GRAM + 1), GRAM)
        anchors = _smallest(grams, LENGTH - GRAM + 1)
        # a segment ends where the smallest hash changes or its first place drops out of the window
        new = np.flatnonzero((anchors[1:] != anchors[:-1]) | (grams[: len(anchors) - 1] == anchors[:-1])) + 1
        first = np.concatenate([[0], new])
        count = np.diff(np.append(first, len(anchors)))
        found.append((anchors[first], substring_hashes(sums, first, count + LENGTH - 1), first + at, count))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 2


def parts(text: bytes, anchor: int, first: int, count: int) -> tuple[np.ndarray, ...]:
    """The windows of a segment in parts of PART neighbours, counted from the place of the anchor.

    Gives, per part: anchor and number as one hash, hash of the bytes that all windows of a full
    part share, hash of all bytes of the part, first window, windows. Equal windows lie in parts
    that agree in the first two.
    """
    data = np.frombuffer(text, np.uint8)[first : first + count + LENGTH - 1]
    sums = polynomial(data)
    # the anchor lies in all windows; ties go to the leftmost
    among = substring_hashes(sums, np.arange(count - 1, LENGTH - GRAM + 1), GRAM)
    place = count - 1 + int(np.argmax(among == np.uint64(anchor)))
    numbers = np.arange((place - count + 1) // PART, place // PART + 1)
    last = place - PART * numbers
    low, high = np.maximum(0, last - PART + 1), np.minimum(count - 1, last)
    lengths = high - low + 1
    return (
        mix(np.uint64(anchor) + numbers.astype(np.uint64)),
        substring_hashes(sums, last, LENGTH - PART + 1),
        substring_hashes(sums, low, lengths + LENGTH - 1),
        first + low,
        lengths,
    )


def windows(text: bytes, first: int, count: int) -> np.ndarray:
    """Hashes of the windows that start at first, first + 1, ..."""
    part = np.frombuffer(text, np.uint8)[first : first + count + LENGTH - 1]
    return substring_hashes(polynomial(part), np.arange(count), LENGTH)


def covered(length: int, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans (start, end) of the bytes covered by windows, from (first window, windows)."""
    spans: list[list[int]] = []
    for first, count in sorted(ranges):
        end = first + count + LENGTH - 1
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([first, end])
    return [(a, min(b, length)) for a, b in spans]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64))


def _places(rows: DataFrame) -> DataFrame:
    """One row (kd, kt, batch, k1, k2, lo, len) per segment."""
    names = ["kd", "kt", "batch", "k1", "k2", "lo", "len"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [segments(x.as_py()) for x in batch.column(3)]
            sizes = [len(p[0]) for p in parts]
            keys = [np.repeat(c.to_numpy(), sizes) for c in batch.columns[:3]]
            if sum(sizes):
                a, s, lo, n = (np.concatenate([p[i] for p in parts]) for i in range(4))
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys), _signed(a), _signed(s), pa.array(lo.astype(np.int64)), pa.array(n.astype(np.int32))], names)

    part = F.pmod(F.xxhash64("kd", "kt"), F.lit(BATCHES)).cast("int")
    schema = "kd long, kt long, batch int, k1 long, k2 long, lo long, len int"
    return rows.select("kd", "kt", part, "body").mapInArrow(run, schema)


def _per_segment(texts: DataFrame, wanted: DataFrame, hashes: list[str], split: Callable[[bytes, int, int, int], tuple[np.ndarray, ...]]) -> DataFrame:
    """Split places (kd, kt, k1, lo, len, alone) with the help of their text: split's hashes, then kd, kt, lo, len, alone."""
    asked = wanted.groupBy("kd", "kt").agg(F.collect_list(F.struct("k1", "lo", "len", "alone")).alias("asked"))
    names = [*hashes, "kd", "kt", "lo", "len", "alone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kd, kt, body, places in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), batch.column(3).to_pylist()):
                text = body.as_py()
                found = [split(text, p["k1"] % (1 << 64), p["lo"], p["len"]) for p in places]
                sizes = [len(f[0]) for f in found]
                *keys, lo, count = (np.concatenate(c) for c in zip(*found))
                alone = np.repeat([p["alone"] for p in places], sizes)
                same = [pa.array(np.full(len(lo), k, np.int64)) for k in (kd, kt)]
                rest = [pa.array(lo.astype(np.int64)), pa.array(count.astype(np.int32)), pa.array(alone)]
                yield pa.RecordBatch.from_arrays([*map(_signed, keys), *same, *rest], names)

    joined = texts.join(asked, ["kd", "kt"]).select("kd", "kt", "body", "asked")
    schema = ", ".join(f"{h} long" for h in hashes) + ", kd long, kt long, lo long, len int, alone boolean"
    return joined.mapInArrow(run, schema)


def _single_windows(text: bytes, anchor: int, first: int, count: int) -> tuple[np.ndarray, ...]:
    at = np.arange(first, first + count)
    return np.full(count, anchor, np.uint64), windows(text, first, count), at, np.ones(count, np.int32)


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)


def _equal_windows(texts: DataFrame, shown: DataFrame, scratch: Scratch) -> DataFrame:
    """Ranges (kd, kt, lo, len) of repeated windows among segments (kd, kt, k1, lo, len, alone) that all differ.

    Segments are compared part by part; only parts that agree in their common bytes and differ in
    all their bytes are compared window by window.
    """
    pieces = scratch.write(_per_segment(texts, shown, ["k1", "common", "whole"], parts), "parts")
    alike = scratch.write(pieces.join(_repeated(pieces, "k1", "common"), ["k1", "common"], "left_semi"), "alike")
    scratch.drop("parts")
    key = F.struct("kd", "kt", "lo", "len")
    kinds = alike.groupBy("k1", "common", "whole").agg(F.count("*").alias("n"), F.min(key).alias("p"), F.max("alone").alias("alone"))
    kinds = scratch.write(kinds, "kinds")
    equal = alike.where("alone").join(kinds.where("n > 1"), ["k1", "common", "whole"], "left_semi").select("kd", "kt", "lo", "len")
    mixed = kinds.join(_repeated(kinds, "k1", "common"), ["k1", "common"], "left_semi")
    asked = mixed.select("p.*", "k1", (F.col("alone") & (F.col("n") == 1)).alias("alone"))
    single = scratch.write(_per_segment(texts, asked, ["k1", "w"], _single_windows), "windows")
    loose = single.where("alone").join(_repeated(single, "k1", "w"), ["k1", "w"], "left_semi").select("kd", "kt", "lo", "len")
    return equal.unionByName(loose)


def _readable(column: str) -> Column:
    """Valid UTF-8 from bytes: every broken part becomes a replacement character, which goes."""
    text = F.col(column).cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))


def _copy(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The texts, bucketed by row key: they are joined twice and moved once."""
    spark, name = rows.sparkSession, f"texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.repartition(buckets, "kd", "kt").write.bucketBy(buckets, "kd", "kt").sortBy("kd", "kt")
    writer.option("compression", "zstd").option("path", scratch.path(name)).saveAsTable(name)
    scratch.release()
    return spark.table(name)


def cut(docs: DataFrame) -> DataFrame:
    """rest (a struct of all columns but text), n_bytes, n_removed, n_spans and kept (the remaining bytes), one row per row of docs."""
    spark = ship_package(docs.sparkSession)
    scratch = Scratch(spark, "suffix-dedup")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    number, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = [F.coalesce(number, F.lit(0)).alias("kd"), F.xxhash64(number, text).alias("kt")]
    texts = _copy(docs.select(*key, text.cast("binary").alias("body"), rest), scratch)
    places = scratch.write(_places(texts), "places")
    runs = SortedRuns(spark, scratch)
    for part in range(BATCHES):
        runs.add(places.where(F.col("batch") == part).select("k1", "k2", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("top")))
    totals = runs.totals().select("k1", "k2", "n")
    several = totals.groupBy("k1").agg(F.count("*").alias("entries")).where("entries > 1").select("k1", F.lit(True).alias("several"))
    entries = totals.join(several, "k1", "left").where("n > 1 OR several")
    entries = scratch.write(entries.select("k1", "k2", (F.col("n") == 1).alias("alone"), F.coalesce("several", F.lit(False)).alias("several")), "entries")
    runs.close()
    hits = scratch.write(places.join(entries, ["k1", "k2"]).select("k1", "k2", "kd", "kt", "lo", "len", "alone", "several"), "hits")
    scratch.drop("places")
    # one place stands for all places of an entry
    shown = hits.where("several").groupBy("k1", "k2", "alone").agg(F.min(F.struct("kd", "kt", "lo", "len")).alias("p")).select("p.*", "k1", "alone")
    ranges = hits.where("NOT alone").select("kd", "kt", "lo", "len").unionByName(_equal_windows(texts, shown, scratch))
    gone = ranges.groupBy("kd", "kt").agg(F.collect_list(F.struct("lo", "len")).alias("ranges"))
    joined = texts.join(gone, ["kd", "kt"], "left").select("rest", "body", "ranges")
    schema = T.StructType([joined.schema["rest"], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, kept = [], []
            for body, found in zip(batch.column(1), batch.column(2).to_pylist()):
                text = body.as_py()
                spans = covered(len(text), {(r["lo"], r["len"]) for r in found or ()})
                edges = [0, *(x for span in spans for x in span), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                numbers.append((len(text), len(text) - len(kept[-1]), len(spans)))
            columns = [pa.array(c, pa.int64()) for c in (zip(*numbers) if numbers else [()] * 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(kept, pa.binary())], names)

    return joined.mapInArrow(run, schema)


def cut_rows(docs: DataFrame) -> DataFrame:
    """docs with the remaining text, and n_chars, where there is such a column, of that text.

    Characters of which only some bytes remain are left out of the text.
    """
    shortened = cut(docs).withColumn("_text", _readable("kept"))
    columns = []
    for c, kind in docs.dtypes:
        if c == "text":
            columns.append(F.col("_text").alias("text"))
        elif c == "n_chars":
            columns.append(F.length("_text").cast(kind).alias("n_chars"))
        else:
            columns.append(F.col(f"rest.`{c}`").alias(c))
    return shortened.select(*columns)
