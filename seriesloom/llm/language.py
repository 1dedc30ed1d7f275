"""Language identification by compression: the language whose dictionary shortens a text most.

Each language gets a zstandard raw-content dictionary of at most DICTIONARY_BYTES, put together from
passages of labelled documents: of every one of DICTIONARY_PARTS hash classes of a language's rows,
the row with the smallest hash gives one passage of at most PASSAGE characters. A text is cut into
blocks of BLOCK bytes, every block is compressed with every dictionary, and the sums are compared;
block by block, the text's own history never hides the dictionary. Where the best dictionary saves
less than NARROW over the second, the text is compared again at CAREFUL_LEVEL. The score is derived
from that saving; `rejected` marks margins below MARGIN.

Defined cases: null texts and texts without a letter give `und` and score 0; with no labelled
language every text is `und`; ties go to the alphabetically first language; rows with a null id
are predicted and never learned from; more than MOST_LANGUAGES distinct values of lang raise an
error; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import crc_mod
from seriesloom.session import ship_package

DICTIONARY_PARTS = 64
PASSAGE = 1024
DICTIONARY_BYTES = 1 << 16
BLOCK = 2048
LEVEL, CAREFUL_LEVEL = 5, 12
NARROW, MARGIN = 0.05, 0.01
MOST_LANGUAGES = 256
HELD_OUT = (4, 2)
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def passages(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary content per language, learned from rows that are not held out."""
    remainder = crc_mod("doc_id", HELD_OUT[0])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0) & (remainder != HELD_OUT[1]))
    size = F.length("text")
    # somewhere in the middle, where the place follows from the hash
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), size - PASSAGE)).cast("int") + 1
    rows = rows.select("lang", F.xxhash64("doc_id").alias("u"), F.col("text").substr(start, F.lit(PASSAGE)).alias("part"))
    best = rows.groupBy("lang", F.pmod("u", F.lit(DICTIONARY_PARTS)).alias("class")).agg(F.min(F.struct("u", "part")).alias("b"))
    found: dict[str, list[str]] = {}
    for row in best.orderBy("lang", "class").limit((MOST_LANGUAGES + 1) * DICTIONARY_PARTS).collect():
        found.setdefault(row.lang, []).append(row.b.part)
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")
    return {lang: "\n".join(parts).lower().encode()[:DICTIONARY_BYTES] for lang, parts in sorted(found.items())}


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False)


class Comparer:
    """Compressed sizes of a text under each dictionary."""

    def __init__(self, contents: dict[str, bytes]):
        self.languages = list(contents)
        self.quick, self.careful = ([_compressor(x, level) for x in contents.values()] for level in (LEVEL, CAREFUL_LEVEL))

    def sizes(self, compressors, blocks: list[bytes]) -> list[tuple[int, str]]:
        return sorted((sum(len(c.compress(b)) for b in blocks), name) for name, c in zip(self.languages, compressors))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow to trust."""
        if not self.languages or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        data = text.lower().encode("utf-8", "surrogatepass")
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = self.sizes(self.quick, blocks)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        margin = 1 - sizes[0][0] / sizes[1][0]
        if margin < NARROW:
            sizes = self.sizes(self.careful, blocks)
            margin = 1 - sizes[0][0] / sizes[1][0]
        return sizes[0][1], min(1.0, 0.5 + 5 * margin), margin < MARGIN


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document."""
    ship_package(docs.sparkSession)
    # at most MOST_LANGUAGES dictionaries of DICTIONARY_BYTES
    shared = docs.sparkSession.sparkContext.broadcast(passages(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comparer = Comparer(shared.value)
        for batch in batches:
            found = [comparer.predict(x.as_py()) for x in batch.column(2)]
            columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.float64(), pa.bool_()))] if found else []
            if columns:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    number = F.col("doc_id").cast("long").alias("doc_id")
    held = F.coalesce(crc_mod(number, HELD_OUT[0]) == HELD_OUT[1], F.lit(False)).alias("held_out")
    schema = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
    return docs.select(number, held, F.col("text").cast("string")).mapInArrow(run, schema)
