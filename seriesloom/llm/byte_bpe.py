"""Byte-level BPE by recursive DuckDB queries inside the tasks, and decoding by ordered aggregation.

A text is split by a pattern. The words a task has not met yet become token rows (word, place,
token, next place, next token); the recursive query joins them with the merge table, takes each
word's pair of smallest rank, leftmost first, contracts it and goes on with the words that had one.
A word that is a token itself is that token. Words of over LONG_WORD bytes, for which the rows of
all steps would be the square of the length, are contracted by the same rule with a heap.
Decoding joins token rows with the vocabulary and aggregates their bytes in order.

The vocabulary file (rank per token, base64) is named by path and read by the tasks; a task keeps
at most KNOWN_WORDS words, then starts anew. Defined cases: null counts as empty, empty texts have
no ids; rows are encoded one by one, repeated or not, null id or not; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.session import ship_package

LONG_WORD = 256
KNOWN_WORDS = 1_000_000
# words contracted by one query, characters and ids worked on at once, rows taken from a batch at once
QUERY_WORDS, PART_CHARS, PART_IDS, PART_ROWS = 10_000, 1 << 20, 1 << 19, 256
# ASCII without control characters, blanks, and letters of Latin scripts: there, Python's own
# expressions match like those with Unicode classes, and faster
LATIN, BLANK = "A-Za-zÀ-ÖØ-öø-ɏ", " \t\n\x0b\x0c\r"

CONTRACT = """
WITH RECURSIVE tokens(step, word, place, token, next_place, next_token) AS (
    SELECT 0, word, place, token, lead(place) OVER w, lead(token) OVER w FROM start WINDOW w AS (PARTITION BY word ORDER BY place)
    UNION ALL (
        WITH best AS MATERIALIZED (
            SELECT word, min((merged::BIGINT << 40) | (place::BIGINT << 20) | next_place) AS pick
            FROM tokens JOIN merges ON pair = ((token::BIGINT << 20) | next_token)
            GROUP BY word
        ), merge AS MATERIALIZED (
            SELECT word, (pick >> 40)::INT AS merged, ((pick >> 20) & 1048575)::INT AS kept, (pick & 1048575)::INT AS gone,
                   tokens.next_place AS after_place, tokens.next_token AS after_token
            FROM best JOIN tokens USING (word) WHERE tokens.place = (pick & 1048575)
        )
        SELECT step + 1, word, place,
               CASE WHEN place = kept THEN merged ELSE token END,
               CASE WHEN place = kept THEN after_place ELSE next_place END,
               CASE WHEN place = kept THEN after_token WHEN next_place = kept THEN merged ELSE next_token END
        FROM tokens JOIN merge USING (word) WHERE place <> gone
    )
)
SELECT word, token FROM tokens WHERE (word, step) IN (SELECT word, max(step) FROM tokens GROUP BY word) ORDER BY word, place
"""

DECODE = """
SELECT doc, array_to_string(list(hex ORDER BY place), '') AS hex FROM ids JOIN vocabulary USING (token) GROUP BY doc ORDER BY doc
"""


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a pattern in a text."""
    general = regex.compile(pattern).findall
    plain = re.sub(r"(\[\^?)([^\]]*)\]", lambda m: m[1] + m[2].replace(r"\p{L}", LATIN).replace(r"\p{N}", "0-9").replace(r"\s", BLANK) + "]", pattern)
    for name, inside in ((r"\p{L}", f"[{LATIN}]"), (r"\p{N}", "[0-9]"), (r"\s", f"[{BLANK}]"), (r"\S", f"[^{BLANK}]")):
        plain = plain.replace(name, inside)
    if re.search(r"\\[a-zA-Z]", plain.replace(BLANK, "")):
        return general
    quick, other = re.compile(plain).findall, re.compile(f"[^ -~{BLANK}{LATIN}]").search
    return lambda text: general(text) if other(text) else quick(text)


class Tokenizer:
    """The vocabulary of a file, its merge table in a DuckDB session of this process, and the words met so far."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.split = splitter(pattern)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        merges = [
            (self.ranks[t[:i]] << 20 | self.ranks[t[i:]], rank)
            for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        self.merges = dict(merges)
        self.session = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.session.register("pairs", pa.table({"pair": [m[0] for m in merges], "merged": [m[1] for m in merges]}))
        self.session.execute("CREATE TABLE merges AS SELECT pair::BIGINT AS pair, merged::INT AS merged FROM pairs")
        self.session.register("words", pa.table({"token": list(self.ranks.values()), "hex": [t.hex() for t in self.ranks]}))
        self.session.execute("CREATE TABLE vocabulary AS SELECT token::INT AS token, hex FROM words")

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not known yet."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        short: list[tuple[str, bytes]] = []
        for word in words - self.known.keys():
            data = word.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(data)
            if rank is not None:
                self.known[word] = np.array([rank], np.int32).tobytes()
            elif len(data) > LONG_WORD:
                self.known[word] = np.array(self._long(data), np.int32).tobytes()
            else:
                short.append((word, data))
        for at in range(0, len(short), QUERY_WORDS):
            self._contract(short[at : at + QUERY_WORDS])

    def _contract(self, words: list[tuple[str, bytes]]) -> None:
        sizes = np.array([len(data) for _, data in words])
        tokens = self.bytes[np.frombuffer(b"".join(data for _, data in words), np.uint8)]
        places = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        numbers = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        self.session.register("start", pa.table({"word": numbers, "place": places.astype(np.int32), "token": tokens}))
        found = self.session.execute(CONTRACT).fetchnumpy()
        self.session.unregister("start")
        ids = np.ascontiguousarray(found["token"], np.int32)
        cuts = np.searchsorted(found["word"], np.arange(len(words) + 1))
        for (word, _), a, b in zip(words, cuts.tolist(), cuts[1:].tolist()):
            self.known[word] = ids[a:b].tobytes()

    def _long(self, data: bytes) -> list[int]:
        """The same contraction with a heap of (rank, place); places are linked both ways."""
        tokens = self.bytes[np.frombuffer(data, np.uint8)].tolist()
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(a: int) -> None:
            b = after[a]
            rank = self.merges.get(tokens[a] << 20 | tokens[b]) if b < len(tokens) else None
            if rank is not None:
                heapq.heappush(heap, (rank, a, tokens[a], tokens[b]))

        for a in range(len(tokens)):
            push(a)
        while heap:
            rank, a, left, right = heapq.heappop(heap)
            b = after[a]
            if tokens[a] != left or b >= len(tokens) or tokens[b] != right:
                continue
            tokens[a], tokens[b], after[a] = rank, -1, after[b]
            if after[b] < len(tokens):
                before[after[b]] = a
            push(a)
            if before[a] >= 0:
                push(before[a])
        return [t for t in tokens if t >= 0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit numbers."""
        out, part, size = [], [], 0
        for text in [*texts, None]:
            if part and (text is None or size > PART_CHARS):
                words = [self.split(t) for t in part]
                self.learn(set().union(*words))
                out += [b"".join(map(self.known.__getitem__, w)) for w in words]
                part, size = [], 0
            if text is not None:
                part.append(text)
                size += len(text)
        return out

    def decode(self, sequences: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of ids."""
        out, part, size = [], [], 0
        for ids in [*sequences, None]:
            if part and (ids is None or size > PART_IDS):
                sizes = [len(x) for x in part]
                rows = {"doc": np.repeat(np.arange(len(part), dtype=np.int32), sizes), "place": np.arange(sum(sizes), dtype=np.int32), "token": np.concatenate(part)}
                self.session.register("ids", pa.table(rows))
                found = self.session.execute(DECODE).fetchnumpy()
                self.session.unregister("ids")
                texts = dict(zip(found["doc"].tolist(), found["hex"]))
                out += [bytes.fromhex(texts.get(i, "")) for i in range(len(part))]
                part, size = [], 0
            if ids is not None:
                part.append(ids)
                size += len(ids)
        return out


@lru_cache(maxsize=1)
def _tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>), one row per row of docs."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, pattern)
        for batch in batches:
            ids = tokenizer.encode(batch.column(1).to_pylist())
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "ids"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and body (the decoded bytes) of rows with doc_id and ids; null ids count as none."""
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, pattern)
        for batch in batches:
            lists = batch.column(1)
            sequences = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokenizer.decode(sequences), pa.binary())], ["doc_id", "ids", "body"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, body binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every text and decode its ids in one pass: doc_id, n_tokens, and digests of the ids and of the decoded bytes."""
    ship_package(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def digest(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(at, PART_ROWS)
                ids = [np.frombuffer(x, np.int32) for x in tokenizer.encode(part.column(1).to_pylist())]
                written = [digest(",".join(map(str, x.tolist())).encode()) for x in ids]
                decoded = [digest(x) for x in tokenizer.decode(ids)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(written), pa.array(decoded)], names)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, schema)
