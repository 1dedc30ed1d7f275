"""Benchmark decontamination on a positional inverted index.

The index is a table of segments. A segment holds up to SEGMENT_WORDS words of documents (a longer
document is a segment of its own): one row per term with its postings, the places of the term in the
segment, and one row under the empty term with the segment's documents. Places of one document
follow each other, and one place stays free between documents, so no phrase crosses them.

A phrase is found by intersecting lists: each term's postings less its offset in the phrase are the
places where the phrase could start. Terms are taken from the rarest on, by their counts over the whole index,
and a list that is empty ends the search. A phrase is sent only to the segments that hold its rarest
term, so work follows the postings of rare terms. Proximity looks from each place of any term of
the query for the next place of all others.

Queries are dealt in batches of QUERY_BATCH, and a task sees the postings of one segment for the terms
of one batch: its memory is bounded by both.

Words are runs of letters and digits after lower-casing A-Z; every character beyond ASCII counts as a letter.
Defined cases: null and empty texts have no words; an item or query without words finds
nothing; rows that repeat a doc_id are documents of their own, and a null doc_id is kept; repeated items
count once per item_id, a null item_id is no item; extra columns are ignored; empty tables give empty results or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import Scratch, salted_join, salted_left_join
from seriesloom.session import ship_package

WINDOW = 10
SEGMENT_WORDS = 1 << 22
QUERY_BATCH = 1 << 16
# everything but digits, letters and bytes of characters beyond ASCII becomes a blank
_BLANKED = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
INDEX = "segment long, term string, n long, body binary"


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(_BLANKED).split()


class _Ids(dict):
    """Numbers for words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _strings(values: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.Array.from_buffers(pa.string(), len(values), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(values))])


class Segment:
    """Collects documents; rows() gives the documents under the empty term, then terms in byte order with their postings."""

    def __init__(self, number: int):
        self.number, self.held = number, 0
        self.doc_ids: list[int | None] = []
        self.parts: list[np.ndarray] = []
        self.ids = _Ids()

    def add(self, doc_id: int | None, found: list[bytes]) -> None:
        self.doc_ids.append(doc_id)
        self.parts.append(np.fromiter(map(self.ids.__getitem__, found), np.int32, len(found)))
        self.held += len(found)

    def rows(self) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(p) for p in self.parts], np.int64)
        known = np.array([i is not None for i in self.doc_ids], np.int64)
        table = np.stack([known, np.array([i or 0 for i in self.doc_ids], np.int64), sizes]).tobytes()
        yield _rows(self.number, [b""], np.array([len(sizes)]), np.array([0, len(table)]), table)
        terms = sorted(self.ids)
        rank = np.empty(len(terms), np.int32)
        rank[[self.ids[t] for t in terms]] = np.arange(len(terms))
        ranked = rank[np.concatenate(self.parts)]
        # one place stays free behind every document
        places = (np.arange(len(ranked)) + np.repeat(np.arange(len(sizes)), sizes)).astype(np.uint32)
        counts = np.bincount(ranked, minlength=len(terms))
        places = places[np.argsort(ranked, kind="stable")]
        ends = np.concatenate([[0], np.cumsum(counts)])
        gaps = np.diff(places, prepend=np.uint32(0))
        gaps[ends[:-1]] = places[ends[:-1]]
        for a in range(0, len(terms), 1 << 16):
            b = min(a + (1 << 16), len(terms))
            yield _rows(self.number, terms[a:b], counts[a:b], 4 * (ends[a : b + 1] - ends[a]), gaps[ends[a] : ends[b]].tobytes())


def _rows(number: int, terms: list[bytes], counts: np.ndarray, offsets: np.ndarray, body: bytes) -> pa.RecordBatch:
    bodies = pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(body)])
    columns = [pa.array(np.full(len(terms), number)), _strings(terms), pa.array(counts.astype(np.int64)), bodies]
    return pa.RecordBatch.from_arrays(columns, ["segment", "term", "n", "body"])


def postings(body: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(body, np.uint32), dtype=np.int64)


def build(docs: DataFrame) -> DataFrame:
    """segment, term, n, body: the index of all rows and whole texts; to be written before it is used."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segment(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(text.as_py() or b"")
                if segment.held and segment.held + len(found) > SEGMENT_WORDS:
                    yield from segment.rows()
                    segment = Segment(segment.number + 1)
                segment.add(doc_id, found)
        if segment.doc_ids:
            yield from segment.rows()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, INDEX)


def tokens(text: Column) -> Column:
    """The same words, by DataFrame functions."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " "), lambda w: w != "")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, terms: every run of `size` words of an item, or all its words if it has fewer."""
    held = items.where(F.col("item_id").isNotNull()).select("item_id", tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))).alias("at")
    return held.select("item_id", "w", at).select("item_id", F.slice("w", F.col("at"), F.lit(size)).alias("terms")).distinct()


def _numbered(queries: DataFrame, scratch: Scratch) -> DataFrame:
    """query, batch, terms with numbers that follow each other; a written table, so they hold."""
    distinct = scratch.write(queries.select("terms").distinct(), "terms")
    parts = distinct.repartition(-(-distinct.count() // QUERY_BATCH) or 1).withColumn("id", F.monotonically_increasing_id())
    rows = scratch.write(parts, "queries")
    # numbers within a task follow each other, so a batch has at most QUERY_BATCH queries
    return rows.withColumn("batch", F.floor(F.col("id") / QUERY_BATCH).cast("long"))


def _segments(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows for the tasks: the documents of every segment, and by (segment, batch) the queries and the postings of their terms.

    Columns: segment, batch, kind (0 documents, 1 postings, 2 queries), term, body, id, terms, counts.
    """
    terms = queries.select("batch", F.explode(F.array_distinct("terms")).alias("term")).distinct()
    # a common term has rows in every segment, so its rows are dealt by segment
    known = salted_join(index.select("segment", "term", "n"), terms.select("term").distinct(), ["term"], F.col("segment"), "left_semi")
    totals = known.groupBy("term").agg(F.sum("n").alias("total"))
    per_term = queries.select("id", F.explode("terms").alias("term")).join(totals, "term", "left")
    counted = per_term.groupBy("id").agg(
        F.min(F.struct(F.coalesce("total", F.lit(0)).alias("total"), "term")).alias("rare"),
        F.map_from_entries(F.collect_set(F.struct("term", F.coalesce("total", F.lit(0)).alias("total")))).alias("counts"),
    )
    # a term that the index lacks: the query is found nowhere
    live = queries.join(counted.where("rare.total > 0"), "id")
    asked = live.select("id", "batch", "terms", F.transform("terms", lambda t: F.col("counts")[t]).alias("counts"), F.col("rare.term").alias("term"))
    sent = salted_join(index.select("segment", "term"), asked, ["term"], F.col("segment"))
    empty = {"term": "string", "body": "binary", "id": "long", "terms": "array<string>", "counts": "array<long>"}

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        have = set(df.columns)
        return df.select("segment", "batch", F.lit(kind).alias("kind"), *[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in empty.items()])

    # the documents of a segment go with its first batch, and also there if no query does
    documents = index.where("term = ''").select("segment", F.lit(0).cast("long").alias("batch"), "body")
    lists = salted_join(index, terms, ["term"], F.col("segment")).select("segment", "batch", "term", "body")
    others = sent.where("batch > 0").select("segment", "batch").distinct()
    more = index.where("term = ''").select("segment", "body").join(others, "segment").select("segment", "batch", "body")
    parts = [shaped(documents.unionByName(more), 0), shaped(lists, 1), shaped(sent.drop("term"), 2)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _search(index: DataFrame, queries: DataFrame, find, apart: bool = False) -> DataFrame:
    """Run find(lists, terms, counts, held) -> (starts, ends) for every query of a segment.

    One row per document and batch: doc (its place in the segment), doc_id, n_words, first (this row stands for the
    document), spans [(start, end)], ids of queries. With apart, one row per document and query that is found there.
    """
    rows = _segments(index, queries).repartition("segment", "batch").sortWithinPartitions("segment", "batch", "kind", "term", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for segment, number, kind, term, body, query, terms, counts in zip(*(batch.column(i) for i in range(8))):
                key = segment.as_py(), number.as_py()
                if held is None or held.key != key:
                    if held:
                        yield from held.rows(apart)
                    held = _Held(key)
                kind = kind.as_py()
                if kind == 0:
                    held.documents(body.as_py())
                elif kind == 1:
                    held.lists[term.as_py()] = postings(body.as_py())
                else:
                    held.add(query.as_py(), *find(held.lists, terms.as_py(), counts.as_py(), held))
        if held:
            yield from held.rows(apart)

    return rows.mapInArrow(run, HITS)


HITS = "segment long, doc int, doc_id long, n_words long, first boolean, spans array<struct<s:long,e:long>>, ids array<long>"
_SPAN = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


class _Held:
    """One segment's documents, the postings of one batch and what was found so far."""

    def __init__(self, key: tuple[int, int]):
        self.key, self.lists = key, {}
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def documents(self, body: bytes) -> None:
        self.known, self.doc_ids, self.sizes = np.frombuffer(body, np.int64).reshape(3, -1)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])[:-1]

    def document_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def add(self, query: int, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(starts):
            self.found.append((starts, ends, np.full(len(starts), query, np.int64)))

    def hits(self, apart: bool) -> Iterator[tuple[int, list[dict], list[int]]]:
        """Document, merged spans and queries."""
        if not self.found:
            return
        starts, ends, queries = (np.concatenate(c) for c in zip(*self.found))
        doc = self.document_of(starts)
        group = queries if apart else np.zeros_like(queries)
        order = np.lexsort([starts, group, doc])
        starts, ends, queries, doc, group = starts[order], ends[order], queries[order], doc[order], group[order]
        edges = [0, *(np.flatnonzero((np.diff(doc) != 0) | (np.diff(group) != 0)) + 1).tolist(), len(doc)]
        for a, b in zip(edges, edges[1:]):
            reach = np.maximum.accumulate(ends[a:b])
            opens = np.concatenate([[True], starts[a + 1 : b] > reach[:-1]])
            rights = reach[np.concatenate([np.flatnonzero(opens)[1:] - 1, [b - a - 1]])]
            base = self.starts[doc[a]]
            spans = [{"s": s, "e": e} for s, e in zip((starts[a:b][opens] - base).tolist(), (rights - base).tolist())]
            yield int(doc[a]), spans, np.unique(queries[a:b]).tolist()

    def rows(self, apart: bool) -> Iterator[pa.RecordBatch]:
        found, first = list(self.hits(apart)), self.key[1] == 0 and not apart
        if first:
            hit = {doc: (spans, ids) for doc, spans, ids in found}
            found = [(doc, *hit.get(doc, ([], []))) for doc in range(len(self.starts))]
        for at in range(0, len(found), 5000):
            docs, spans, ids = zip(*found[at : at + 5000])
            place = np.array(docs)
            columns = [
                pa.array(np.full(len(docs), self.key[0])), pa.array(place.astype(np.int32)), pa.array(self.doc_ids[place], mask=self.known[place] == 0),
                pa.array(self.sizes[place]), pa.array(np.full(len(docs), first)), pa.array(spans, _SPAN), pa.array(ids, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["segment", "doc", "doc_id", "n_words", "first", "spans", "ids"])


def phrase_starts(lists: dict[str, np.ndarray], terms: list[str], counts: list[int]) -> np.ndarray:
    """Places where the phrase starts, by intersecting offset-adjusted postings from the rarest term on."""
    starts = None
    for at in sorted(range(len(terms)), key=lambda i: (counts[i], i)):
        places = lists.get(terms[at])
        if places is None:
            return np.zeros(0, np.int64)
        if starts is None:
            starts = places - at
        else:
            found = np.searchsorted(places, starts + at)
            starts = starts[places[np.minimum(found, len(places) - 1)] == starts + at]
        if not len(starts):
            break
    return starts


def near_starts(lists: dict[str, np.ndarray], terms: list[str], within: int, documents: _Held) -> tuple[np.ndarray, np.ndarray]:
    """Shortest stretches of at most `within` words of one document that hold all terms in any order: first places, ends."""
    wanted = [lists.get(t) for t in dict.fromkeys(terms)]
    if any(x is None for x in wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.unique(np.concatenate(wanted))
    ends = starts.copy()
    for places in wanted:
        after = np.searchsorted(places, starts)
        live = after < len(places)
        starts, ends, after = starts[live], ends[live], after[live]
        ends = np.maximum(ends, places[after])
    fits = (ends - starts < within) & (documents.document_of(starts) == documents.document_of(ends))
    starts, ends = starts[fits], ends[fits]
    # of stretches with one end, the shortest
    last = np.concatenate([ends[1:] != ends[:-1], np.ones(min(1, len(ends)), bool)])
    return starts[last], ends[last] + 1


def phrases(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact matches of the phrases (terms) of queries (id, batch, terms); _search tells the columns."""

    def find(lists, terms, counts, _):
        starts = phrase_starts(lists, terms, counts)
        return starts, starts + len(terms)

    return _search(index, queries, find)


def proximity(docs: DataFrame, items: DataFrame, within: int) -> DataFrame:
    """doc_id, item_id, spans [(start, end)]: where all words of an item lie within `within` words, in any order.

    Spans are word places of the document, the end exclusive; overlapping ones are merged.
    """
    scratch = Scratch(ship_package(docs.sparkSession), "proximity")
    index = scratch.write(build(docs), "index")
    held = items.where(F.col("item_id").isNotNull()).select("item_id", F.array_sort(F.array_distinct(tokens(F.col("text")))).alias("terms")).where(F.size("terms") > 0)
    queries = _numbered(held, scratch)
    found = _search(index, queries, lambda lists, terms, counts, documents: near_starts(lists, terms, within, documents), apart=True)
    named = held.join(queries.select("id", "terms"), "terms").select("id", "item_id")
    return found.select("doc_id", F.explode("ids").alias("id"), "spans").join(named, "id").select("doc_id", "item_id", "spans")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans of hit words [(start, end)] and item_ids (ascending as strings) of every row of docs."""
    scratch = Scratch(ship_package(docs.sparkSession), "decontaminate")
    index = scratch.write(build(docs), "index")
    runs = scratch.write(windows(items, size), "windows")
    queries = _numbered(runs, scratch)
    found = scratch.write(phrases(index, queries), "found")
    scratch.drop("index")
    key = ["segment", "doc"]
    owners = runs.join(queries.select("id", "terms"), "terms").select("id", F.col("item_id").cast("string").alias("item"))
    hits = found.where(F.size("ids") > 0).select(*key, F.explode("ids").alias("id")).distinct()
    # many documents may share a window, and many items too: a window's items travel as one list
    lists = owners.groupBy("id").agg(F.collect_set("item").alias("items"))
    held = salted_left_join(hits, lists, ["id"], F.struct(*key))
    named = held.select(*key, F.explode("items").alias("item")).groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    whole = found.where("first").select(*key, "doc_id", "n_words", "spans")
    later = found.where("not first").groupBy(*key).agg(F.flatten(F.collect_list("spans")).alias("more"))
    joined = whole.join(later, key, "left").join(named, key, "left")
    empty = F.array().cast("array<string>")
    spans = F.when(F.col("more").isNull(), F.col("spans")).otherwise(merged(F.concat("spans", "more")))
    return joined.select("doc_id", "n_words", spans.alias("spans"), F.coalesce("item_ids", empty).alias("item_ids"))


def merged(spans: Column) -> Column:
    """Overlapping and touching spans as one."""
    last = lambda done: F.element_at(done, -1)

    def add(done: Column, x: Column) -> Column:
        joins = (F.size(done) > 0) & (x["s"] <= F.try_element_at(done, F.lit(-1))["e"])
        grown = F.struct(last(done)["s"].alias("s"), F.greatest(last(done)["e"], x["e"]).alias("e"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<s:bigint,e:bigint>>"), add)
