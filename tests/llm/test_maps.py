"""Operators that treat every document by itself, and the trained ones."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
from seriesloom.llm import byte_bpe, language, packing, quality_classifier, quality_rules, toxicity
from seriesloom.llm.common import table
from seriesloom.llm.grams import gram_ids

SF = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def held_out_rows(found, known, column):
    rows = found.merge(known.dropna(subset=[column]), on="doc_id")
    return rows[rows["held_out"]]


def test_quality_of_held_out_rows(spark):
    found = entry.queries()["op1_quality_classifier"](spark, SF).toPandas()
    assert len(found) == 1000 and found["score"].between(0, 1).all()
    rows = held_out_rows(found, table(spark, SF, "labels").toPandas(), "quality")
    assert (rows["predicted"] == rows["quality"]).mean() > 0.97


def test_toxicity_of_held_out_rows(spark):
    found = entry.queries()["op8_toxicity"](spark, SF).toPandas()
    assert len(found) == 1000 and found["score"].between(0, 1).all()
    rows = held_out_rows(found, table(spark, SF, "labels").toPandas(), "toxic")
    # a few hundred labels: the model must not call clean texts toxic
    assert (rows["predicted"] == rows["toxic"]).mean() > 0.85
    assert (rows.loc[rows["toxic"] == 0, "predicted"] == 0).mean() > 0.97


def test_language_of_held_out_rows(spark):
    found = entry.queries()["op9_language"](spark, SF).toPandas()
    rows = held_out_rows(found, table(spark, SF, "documents").toPandas()[["doc_id", "lang"]], "lang")
    assert len(found) == 1000 and (rows["lang_pred"] == rows["lang"]).mean() > 0.97


def test_trained_operators_on_odd_rows(spark, make_docs, odd_pairs):
    docs = make_docs(odd_pairs)
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 1), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for found in (quality_classifier.classify(docs, labels), toxicity.classify(docs, labels)):
        rows = found.collect()
        assert len(rows) == len(odd_pairs) and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out is False for r in rows if r.doc_id is None)
    rows = {r.doc_id: r for r in language.identify(docs).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and rows[4].lang_pred == "en"
    none = labels.where("false")
    assert {r.score for r in quality_classifier.classify(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.classify(docs, none).collect()} == {0.5}
    assert {r.lang_pred for r in language.identify(make_docs(odd_pairs, None)).collect()} == {"und"}
    assert toxicity.keep_clean(docs, none).columns == docs.columns


def test_empty_table(spark, make_docs):
    docs = make_docs([])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    encoded = byte_bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN)
    for found in (
        quality_classifier.classify(docs, labels), toxicity.classify(docs, labels), toxicity.keep_clean(docs, labels), language.identify(docs),
        quality_rules.judge(docs), packing.pack(docs), byte_bpe.decode(encoded, VOCABULARY, public_tokenizers.PATTERN),
    ):
        assert found.collect() == []


def test_monotone_calibration():
    at, values = quality_classifier.pool_adjacent(np.arange(5.0), np.array([1, 1, 2, 1, 1]), np.array([0, 1, 0.5, 0.2, 1]))
    assert (np.diff(values) > 0).all() and (np.diff(at) > 0).all()
    assert values.tolist() == pytest.approx([0, 2.2 / 4, 1])


def test_grams_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(random.Random(1).choices(["alpha", "beta", "gamma", "delta", "eps"], k=500))
    whole = gram_ids(text, 20)
    monkeypatch.setattr("seriesloom.llm.grams._PIECE", 64)
    assert gram_ids(text, 20).tolist() == whole.tolist()
    assert gram_ids("Alpha, BETA", 20).tolist() == gram_ids("alpha beta", 20).tolist()


def test_rules_against_sql_and_odd_rows(spark, make_docs, odd_pairs):
    rows = quality_rules.judge(make_docs(odd_pairs)).collect()
    assert len(rows) == len(odd_pairs)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_words == by_id[3].word_chars == 0 and by_id[2].base_failed and not by_id[2].kept
    assert by_id[4].kept and by_id[7].n_words == 40_000
    repeated = make_docs([(1, "a b c d e f g h " * 4), (2, " ".join(map(str, range(30)))), (3, "x y\nx y\n \n \nz")])
    found = {r.doc_id: r for r in quality_rules.judge(repeated).collect()}
    assert found[1].n_repeat_words == 32 and found[2].n_repeat_words == 0 and found[3].n_dup_lines == 1


def test_rule_order_follows_rejection_per_cost(spark, make_docs):
    docs = make_docs([(i, "abc " * 10 + "### " * i) for i in range(40)])
    order = quality_rules.plan(docs.select("doc_id", "text"))
    gains = [share / seconds for _, seconds, share in order]
    assert gains == sorted(gains, reverse=True) and order[0][0] == "symbols" and len(order) == len(quality_rules.rules())


def test_bpe_equals_the_library(spark, make_docs, odd_pairs, reference):
    rng = random.Random(5)
    hard = ["".join(rng.choice("thenaigor ") for _ in range(4000)), "a" * 1500, " " * 700 + "x", "日本語" * 200, "<|endoftext|> it's we'll", "=" * 300]
    pairs = odd_pairs + [(100 + i, t) for i, t in enumerate(hard)]
    encoded = byte_bpe.encode(make_docs(pairs), VOCABULARY, public_tokenizers.PATTERN)
    found = byte_bpe.decode(encoded, VOCABULARY, public_tokenizers.PATTERN).collect()
    want = sorted((i or 0, reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in pairs)
    assert sorted((r.doc_id or 0, r.ids, bytes(r.body)) for r in found) == want


def test_bpe_query(spark, reference):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    for r in entry.queries()["op7_byte_bpe"](spark, sf).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_long_words_like_short_ones(monkeypatch):
    tokenizer = byte_bpe.Tokenizer(VOCABULARY, public_tokenizers.PATTERN)
    words = ["".join(random.Random(i).choice("enthilras") for _ in range(60)) for i in range(40)]
    short = tokenizer.encode(words)
    tokenizer.known.clear()
    monkeypatch.setattr(byte_bpe, "LONG_WORD", 1)
    assert tokenizer.encode(words) == short


def test_packing_keeps_every_word(spark, make_docs, odd_pairs):
    rows = packing.pack(make_docs(odd_pairs + [(50 + i, "w " * (i * 37 % 700)) for i in range(200)])).toPandas()
    sums = rows.groupby("doc_id")["piece_length"].sum()
    assert sums[7] == 40_000 and sums[2] == 0 and sums[4] == 3 * 28 and sums[51] == 37
    assert rows["bin_id"].isna().equals(rows["piece_length"] == 0)
    packed = rows.dropna(subset=["bin_id"])
    for _, held in packed.groupby("bin_id"):
        held = held.sort_values("bin_offset")
        ends = (held["bin_offset"] + held["piece_length"]).tolist()
        assert held["bin_offset"].tolist() == [0, *ends[:-1]] and ends[-1] <= held["bin_capacity"].iloc[0]
        # no smaller permitted length would do
        assert all(c < ends[-1] for c in packing.CAPACITIES if c < held["bin_capacity"].iloc[0])


def test_best_fit_choices():
    bins, offsets, sizes = packing.pack_lengths([4096, 3000, 1000, 90, 6], packing.CAPACITIES)
    assert bins == [0, 1, 1, 1, 1] and offsets == [0, 0, 3000, 4000, 4090] and sizes == [4096, 4096]
    assert packing.pack_lengths([10], packing.CAPACITIES) == ([0], [0], [256])
    assert packing.pack_lengths([], packing.CAPACITIES) == ([], [], [])
