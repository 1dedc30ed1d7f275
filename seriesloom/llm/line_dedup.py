"""Line dedup: levelled sorted runs of line hashes.

The key of a line is the line without white space at both ends and with A-Z lower-cased. Documents
arrive in batches. Each batch folds its keys of at least MIN_CHARS code points to one row per key,
anti-joins the sorted runs of the batches before it, and is added as a run that tells new keys from
known ones; runs of equal level are compacted. Keys found in at least MIN_DOCUMENTS documents lose
all their lines but those of the largest doc_id that holds them.

Keys are compared by their 128-bit XXH3 hash. Defined cases: a null or empty text is one empty line
and keeps it; a null doc_id is smaller than any other; rows that repeat a doc_id count as documents
of their own and, if the doc_id is the largest, all keep their lines; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import Scratch, keyed
from seriesloom.llm.runs import KEY, SortedRuns
from seriesloom.session import ship_package

MIN_CHARS = 20
MIN_DOCUMENTS = 3
BATCHES = 2
_BLANKS = b" \t\n\x0b\x0c\r"
_HALF = (1 << 64) - 1


def line_keys(text: bytes) -> list[tuple[int, int, int]]:
    """(line number, two signed halves of the key's hash) of the lines that are long enough."""
    found = []
    for at, line in enumerate(text.split(b"\n")):
        key = line.strip(_BLANKS).lower()
        # a code point has one to four bytes
        if len(key) >= MIN_CHARS and (len(key) >= 4 * MIN_CHARS or len(key.decode("utf-8", "replace")) >= MIN_CHARS):
            h = xxhash.xxh3_128_intdigest(key)
            halves = h >> 64, h & _HALF
            found.append((at, *(x - (1 << 64) if x >> 63 else x for x in halves)))
    return found


def _members(batch: DataFrame) -> DataFrame:
    """k1, k2, n, top: one row for each distinct key of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).cast(pa.binary())):
                out += [(*k, 1, doc_id) for k in {x[1:] for x in line_keys(text.as_py())}]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 4)], ["k1", "k2", "n", "top"])

    return batch.select("doc_id", "text").mapInArrow(run, "k1 long, k2 long, n long, top long")


def _lines(rows: DataFrame) -> DataFrame:
    """kd, kt, doc_id, at, k1, k2 of every line with a key."""
    names = ["kd", "kt", "doc_id", "at", *KEY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = (line_keys(x.as_py()) for x in batch.column(3).cast(pa.binary()))
            out = [(*row, *key) for *row, found in zip(*(c.to_pylist() for c in batch.columns[:3]), keys) for key in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 6)], names)

    return rows.select("kd", "kt", "doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def strip_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text and the row key (kd, kt), one row per row of docs."""
    spark = ship_package(docs.sparkSession)
    scratch = Scratch(spark, "line-dedup")
    rows = keyed(docs)
    runs = SortedRuns(spark, scratch)
    for part in range(BATCHES):
        runs.add(_members(rows.where(F.pmod(F.xxhash64("kd", "kt"), F.lit(BATCHES)) == part)))
    frequent = scratch.write(runs.totals().where(F.col("n") >= MIN_DOCUMENTS).select(*KEY, "top"), "frequent")
    runs.close()
    lost = _lines(rows).join(frequent, KEY).where(F.coalesce(F.col("doc_id") < F.col("top"), F.col("top").isNotNull()))
    drops = lost.groupBy("kd", "kt").agg(F.collect_set(F.col("at").cast("int")).alias("drops"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, kept = [], []
            for text, gone in zip(batch.column(3).cast(pa.binary()), batch.column(4).to_pylist()):
                lines, gone = text.as_py().split(b"\n"), set(gone or ())
                counts.append((len(lines), len(gone)))
                kept.append(b"\n".join(x for at, x in enumerate(lines) if at not in gone) if gone else text.as_py())
            numbers = [pa.array(c, pa.int64()) for c in (zip(*counts) if counts else [()] * 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *numbers, pa.array(kept, pa.binary()).cast(pa.string())], names)

    names = ["kd", "kt", "doc_id", "n_lines", "n_dropped", "kept_text"]
    joined = rows.join(drops, ["kd", "kt"], "left").select("kd", "kt", "doc_id", "text", "drops")
    return joined.mapInArrow(run, "kd long, kt long, doc_id long, n_lines long, n_dropped long, kept_text string")
