"""Phrase collocation mining with weighted acyclic automata.

Every word of a text opens a window of up to MAX_WORDS words of its piece. A chunk of texts sorts its
windows and builds a count transducer from them, one after the other: a window shares the states of
the prefix that it has in common with the one before and adds new states for the rest; its weight is
its count. The weight of a prefix, summed over all paths through its state, is how often that phrase
occurs, so one automaton holds the counts of all phrases, and the states of a language hold its word count.

Transducers are cut at common bounds into prefix ranges of equal work and united range by range: paths meet, weights add.
A hot word or phrase may span ranges: states on the first and last path of a range carry part of a
weight, and those parts are added at the end. No state under the least count is kept elsewhere.
The united automaton's states are the table `counts`; composing a candidate's two parts with it is a join.

Scores are exact (decimals of 38 digits; a count may reach 10^12 words). Defined cases: null and empty texts
have no words; a null language is `und`; repeated rows count as often as they come; doc_id and extra columns
are ignored; ties go to the smaller cut and, in the ranking, to the smaller phrase in byte order; empty tables give
an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import Scratch
from seriesloom.session import ship_package

MAX_WORDS = 5
LEAST = 100
TOP = 2000
FACTOR = 1000
# words of a chunk, and of a prefix range
CHUNK_WORDS = 1 << 21
RANGE_WORDS = 1 << 21
# windows drawn for each range to place the bounds; they decide the balance of the tasks, not the result
DRAWN = 100
_BREAK = b"."
_TABLE = bytes(0x2E if chr(c) in ".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, with a break between pieces."""
    return text.lower().translate(_TABLE).replace(_BREAK, b" . ").split()


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def lexical_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by all columns of non-negative integers; as many columns as fit share one key."""
    keys, room = [], 0
    for column in columns:
        bits = max(1, int(column.max(initial=0)).bit_length())
        if keys and bits <= room:
            keys[-1] = (keys[-1] << bits) | column.astype(np.int64)
            room -= bits
        else:
            keys.append(column.astype(np.int64))
            room = 63 - bits
    return np.lexsort(keys[::-1])


class Transducer:
    """Distinct windows in order: language and words by number (0: ended), and the weight of every path."""

    def __init__(self, columns: list[np.ndarray], weight: np.ndarray):
        """columns: sorted rows, equal ones next to each other."""
        fresh = first_difference(columns) < len(columns)
        at = np.flatnonzero(fresh)
        self.columns = [c[at] for c in columns]
        self.weight = np.add.reduceat(weight, at) if len(at) else weight
        self.level = first_difference(self.columns)

    def states(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First rows and weights of the states of depth k; depth 0 is the language."""
        at = np.flatnonzero(self.level <= k)
        weight = np.add.reduceat(self.weight, at) if len(at) else self.weight
        live = self.columns[k][at] > 0
        return at[live], weight[live]


def first_difference(columns: list[np.ndarray]) -> np.ndarray:
    """The first column in which a row differs from the row before; len(columns) if in none."""
    level = np.full(len(columns[0]), len(columns), np.uint8)
    for k in range(len(columns) - 1, -1, -1):
        level[1:][columns[k][1:] != columns[k][:-1]] = k
    level[:1] = 0
    return level


class Chunk:
    """Texts whose windows go into one transducer."""

    def __init__(self):
        self.ids, self.langs, self.held = _Ids({_BREAK: 0}), _Ids(), 0
        self.parts: list[np.ndarray] = []
        self.lang_of: list[int] = []

    def add(self, lang: bytes, text: bytes) -> None:
        found = tokens(text)
        if found:
            found.append(_BREAK)
            self.parts.append(np.fromiter(map(self.ids.__getitem__, found), np.int32, len(found)))
            self.lang_of.append(self.langs[lang])
            self.held += len(found)

    def windows(self) -> tuple[list[np.ndarray], list[bytes], list[bytes]]:
        """Columns of all windows, with words and languages numbered from 1 in byte order."""
        terms, langs = sorted(w for w in self.ids if w != _BREAK), sorted(self.langs)
        rank = np.zeros(len(self.ids), np.int32)
        rank[[self.ids[w] for w in terms]] = np.arange(1, len(terms) + 1)
        lang_rank = np.zeros(len(langs), np.int32)
        lang_rank[[self.langs[x] for x in langs]] = np.arange(1, len(langs) + 1)
        flat = rank[np.concatenate([*self.parts, np.zeros(MAX_WORDS, np.int32)])]
        at = np.flatnonzero(flat)
        lang = np.repeat(lang_rank[self.lang_of], [len(p) for p in self.parts])
        columns = [lang[at], flat[at]]
        for k in range(1, MAX_WORDS):
            columns.append(np.where(columns[-1] > 0, flat[at + k], 0))
        return columns, terms, langs

    def slices(self, bounds: list[tuple[bytes, ...]]) -> Iterator[pa.RecordBatch]:
        """The transducer's paths, cut into prefix ranges."""
        columns, terms, langs = self.windows()
        edges = np.array([_placed(b, langs, terms) for b in bounds], np.int32).reshape(-1, MAX_WORDS + 1)
        # places of words are even, those between words odd; a bound comes before windows that equal it
        both = [np.concatenate([edges[:, k], 2 * c]) for k, c in enumerate(columns)]
        window = np.ones(len(both[0]), np.int8)
        window[: len(edges)] = 0
        order = lexical_order([*both, window])
        del both
        number = np.cumsum(window[order] == 0)[window[order] == 1]
        order = order[order >= len(edges)] - len(edges)
        columns = [number.astype(np.int32), *(c[order] for c in columns)]
        united = Transducer(columns, np.ones(len(order), np.int64))
        number = united.columns[0]
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield encode(int(number[a]), [c[a:b] for c in united.columns[1:]], united.weight[a:b], terms, langs)


def _placed(bound: tuple[bytes, ...], langs: list[bytes], terms: list[bytes]) -> list[int]:
    places = []
    for k, word in enumerate(bound):
        known = terms if k else langs
        at = bisect_left(known, word)
        if at < len(known) and known[at] == word:
            places.append(2 * at + 2)
        else:
            places.append(2 * at + 1)
            break
    return places + [0] * (MAX_WORDS + 1 - len(places))


SLICE = "range int, langs array<binary>, lang binary, step binary, weight binary, label binary, words binary"
_SLICE = pa.schema([
    ("range", pa.int32()), ("langs", pa.list_(pa.binary())), ("lang", pa.binary()), ("step", pa.binary()), ("weight", pa.binary()),
    ("label", pa.binary()), ("words", pa.binary()),
])


def encode(number: int, columns: list[np.ndarray], weight: np.ndarray, terms: list[bytes], langs: list[bytes]) -> pa.RecordBatch:
    """One row: for each path how many words it shares with the last one, its depth, and the labels of its new states."""
    words = columns[1:]
    shared = first_difference(columns)
    shared = np.where(shared > 0, shared - 1, 0).astype(np.uint8)
    depth = np.sum([c > 0 for c in words], axis=0, dtype=np.uint8)
    new = np.stack([(shared <= k) & (k < depth) for k in range(MAX_WORDS)], axis=1)
    used, label = np.unique(np.stack(words, axis=1)[new], return_inverse=True)
    small = np.uint16 if len(used) <= 1 << 16 else np.uint32
    pack = zstandard.ZstdCompressor(level=1).compress
    row = (
        number, langs, pack(columns[0].astype(np.uint32).tobytes()), pack((shared * 8 + depth).tobytes()), pack(weight.astype(np.uint32).tobytes()),
        pack(label.astype(small).tobytes()), pack(b" ".join([terms[i - 1] for i in used.tolist()])),
    )
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _SLICE.types)], schema=_SLICE)


def decode(row: dict) -> tuple[list[np.ndarray], np.ndarray, list[bytes]]:
    """Columns (language by place in row["langs"] from 1, words by number from 1), weights, and the words."""
    unpack = zstandard.ZstdDecompressor().decompress
    words = unpack(row["words"]).split(b" ")
    step = np.frombuffer(unpack(row["step"]), np.uint8)
    shared, depth = step >> 3, step & 7
    new = np.stack([(shared <= k) & (k < depth) for k in range(MAX_WORDS)], axis=1)
    small = np.uint16 if len(words) <= 1 << 16 else np.uint32
    table = np.zeros(new.shape, np.int32)
    table[new] = np.frombuffer(unpack(row["label"]), small).astype(np.int32) + 1
    columns = [np.frombuffer(unpack(row["lang"]), np.uint32).astype(np.int32)]
    for k in range(MAX_WORDS):
        # a shared state has the label of the last path that made a new one here
        last = np.maximum.accumulate(np.where(new[:, k], np.arange(len(step)), 0))
        columns.append(np.where(k < depth, table[last, k], 0))
    return columns, np.frombuffer(unpack(row["weight"]), np.uint32).astype(np.int64), words


def unite(rows: list[dict]) -> tuple[Transducer, list[bytes], list[bytes]]:
    """The union of slices of one range: one path per window, weights added."""
    parts = [decode(r) for r in rows]
    terms = sorted(set().union(*(p[2] for p in parts)))
    langs = sorted(set().union(*(r["langs"] for r in rows)))
    word_rank = {w: i for i, w in enumerate(terms, 1)}
    lang_rank = {x: i for i, x in enumerate(langs, 1)}
    columns: list[list[np.ndarray]] = [[] for _ in range(MAX_WORDS + 1)]
    for (held, _, words), row in zip(parts, rows):
        to_word = np.fromiter([0, *map(word_rank.__getitem__, words)], np.int32)
        to_lang = np.fromiter([0, *map(lang_rank.__getitem__, row["langs"])], np.int32)
        for k, c in enumerate(held):
            columns[k].append(to_word[c] if k else to_lang[c])
    joined = [np.concatenate(c) for c in columns]
    order = lexical_order(joined)
    return Transducer([c[order] for c in joined], np.concatenate([p[1] for p in parts])[order]), terms, langs


STATES = "lang binary, size int, phrase binary, f long"
_STATES = pa.schema([("lang", pa.binary()), ("size", pa.int32()), ("phrase", pa.binary()), ("f", pa.int64())])


def frequent_states(rows: list[dict], least: int) -> pa.Table:
    """States of one range: those with the least count, all languages, and those that neighbouring ranges may share."""
    united, terms, langs = unite(rows)
    out = []
    for k in range(MAX_WORDS + 1):
        at, weight = united.states(k)
        keep = (weight >= least) | (k == 0)
        # states on the first and the last path may go on in the neighbouring ranges
        keep[:1] = keep[-1:] = True
        for i, f in zip(at[keep].tolist(), weight[keep].tolist()):
            phrase = b" ".join([terms[united.columns[j][i] - 1] for j in range(1, k + 1)])
            out.append((langs[united.columns[0][i] - 1], k, phrase, f))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _STATES.types)], schema=_STATES)


def _bounds(texts: DataFrame) -> list[tuple[bytes, ...]]:
    """Windows between which prefix ranges lie, from a random draw of windows; one per RANGE_WORDS words, or per task if that is more."""
    spark = texts.sparkSession
    # a word has at least two bytes with its blank
    n_words = (texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0) // 2
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_words // RANGE_WORDS))
    wanted = DRAWN * ranges
    # of every document drawn about one window in 16 is taken
    share = min(1.0, 16 * wanted / max(1, n_words))
    rate = min(1.0, wanted / max(1.0, share * n_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = tokens(text.as_py())
                for at in np.flatnonzero(rng.random(len(found)) < rate).tolist():
                    window = found[at : at + MAX_WORDS]
                    window = window[: window.index(_BREAK)] if _BREAK in window else window
                    if window:
                        out.append([lang, *window])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary()))], ["path"])

    drawn = texts.sample(share, seed=7).mapInArrow(run, "path array<binary>").distinct()
    dealt = drawn.repartitionByRange(ranges, "path")
    firsts = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min("path").alias("path")).orderBy("path").collect()
    return [tuple(bytes(w) for w in r.path) for r in firsts[1:]]


def counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, size, phrase, f: all phrases of up to MAX_WORDS words with f >= least, and per language its words (size 0)."""
    scratch = Scratch(ship_package(docs.sparkSession), "collocations")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary").alias("lang")
    texts = docs.select(lang, F.col("text").cast("string").cast("binary").alias("text")).where("text IS NOT NULL")
    bounds = _bounds(texts)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk()
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                chunk.add(lang.as_py(), text.as_py())
                if chunk.held >= CHUNK_WORDS:
                    yield from chunk.slices(bounds)
                    chunk = Chunk()
        if chunk.held:
            yield from chunk.slices(bounds)

    def merge(table: pa.Table) -> pa.Table:
        return frequent_states(table.to_pylist(), least)

    states = texts.mapInArrow(shards, SLICE).groupBy("range").applyInArrow(merge, STATES)
    summed = states.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("size") == 0))
    return scratch.write(summed.select(F.col("lang").cast("string").alias("lang"), "size", F.col("phrase").cast("string").alias("phrase"), "f"), "counts")


def _part(first: int | F.Column, size: F.Column) -> F.Column:
    return F.array_join(F.slice("w", first, size), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of every language."""
    found = counts(docs, least)
    scratch = Scratch(docs.sparkSession, "scored")
    phrases = found.where("size >= 2").withColumn("w", F.split("phrase", " "))
    # a phrase inside one two words longer is also inside the one between, which is at least as frequent
    inner = phrases.where("size >= 3").select("lang", F.explode(F.array(_part(1, F.col("size") - 1), _part(2, F.col("size") - 1))).alias("phrase"), "f")
    over = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = phrases.join(over, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 100 * f")
    cuts = kept.select("lang", "phrase", "w", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    k = F.col("k")
    parts = cuts.select("lang", "phrase", "a", "k", _part(1, k).alias("left_part"), _part(k + 1, F.col("size") - k).alias("right_part"))
    part = found.where("size > 0")
    composed = parts.join(part.select("lang", F.col("phrase").alias("left_part"), F.col("f").alias("l")), ["lang", "left_part"])
    composed = composed.join(part.select("lang", F.col("phrase").alias("right_part"), F.col("f").alias("r")), ["lang", "right_part"])
    composed = composed.join(found.where("size = 0").select("lang", F.col("f").alias("n")), "lang")
    # both products stay below 10^38 for counts up to 10^12 words; the quotient is at most FACTOR * n / least
    wide = "decimal(38,0)"
    above, below = (F.lit(FACTOR) * F.col("a")).cast("decimal(19,0)") * F.col("n").cast("decimal(18,0)"), F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(18,0)")
    scored = composed.withColumns({"above": above.cast(wide), "below": below.cast(wide)}).withColumn("score", F.expr("above div below"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    table = scratch.write(lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most phrases: its parts are cut to `top` first
    salted = table.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    early = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    final = early.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return final.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
