"""Phrases, proximity and decontamination against brute force."""

import random
import re

from pyspark.sql import functions as F

from seriesloom.llm import positional_index as pi

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    grams = [(str(i), w[a : a + size]) for i, t in items if i is not None for w in [split(t)] if w for a in range(max(1, len(w) - size + 1))]
    out = []
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for item, gram in grams:
            for a in range(len(w) - len(gram) + 1):
                if w[a : a + len(gram)] == gram:
                    hit |= set(range(a, a + len(gram)))
                    found.add(item)
        out.append((doc_id, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


def collected(df):
    rows = [(r.doc_id, r.n_words, [i for s in r.spans for i in range(s.s, s.e)], r.item_ids) for r in df.collect()]
    return sorted(rows, key=repr)


def corpus(n=120):
    rng = random.Random(3)
    vocabulary = ["the"] * 30 + ["Of", "and"] * 8 + [f"w{i}" for i in range(40)] + ["Éa", "naïve", "日本", "x9"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 120))) for _ in range(n)]
    # a passage in every document but one
    texts = [t + ". the common passage of words that every single document has in it!" for t in texts[:-1]] + texts[-1:]
    items = [(i, " ".join(rng.choice(texts).split()[a : a + 25])) for i, a in enumerate(rng.choices(range(40), k=25))]
    items += [(100, "the"), (101, "of the"), (102, "Naïve 日本"), (7, "absent words only"), (8, "the common passage of words that every single document has in it")]
    return list(enumerate(texts)), items


def test_phrases_against_brute_force(spark, make_docs, monkeypatch):
    docs, items = corpus()
    frame = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, terms string")
    for words_per_segment, batch in ((300, 64), (1 << 20, 1 << 16)):
        monkeypatch.setattr(pi, "SEGMENT_WORDS", words_per_segment)
        monkeypatch.setattr(pi, "QUERY_BATCH", batch)
        assert collected(pi.decontaminate(make_docs(docs), frame)) == brute(docs, items)


def test_odd_rows(spark, make_docs, odd_pairs):
    items = [(1, "quick BROWN fox jumps over the lazy dog and then runs"), (1, "quick brown fox"), (None, "x"), (2, None), (3, " ... "), (4, "x"), (5, "一二三四五")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert collected(pi.decontaminate(make_docs(odd_pairs), frame)) == brute(odd_pairs, items)
    assert collected(pi.decontaminate(make_docs(odd_pairs), frame.where("false"))) == brute(odd_pairs, [])
    assert pi.decontaminate(make_docs([]), frame).collect() == []


def test_proximity_against_brute_force(spark, make_docs, monkeypatch):
    docs, _ = corpus(40)
    items = [(1, "w1 of w2"), (2, "naïve w3"), (3, "passage common"), (4, "the the"), (5, "absent the"), (None, "the"), (6, "")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(pi, "SEGMENT_WORDS", 200)
    within = 6
    want = set()
    for doc_id, text in docs:
        w = split(text)
        for item, t in items:
            wanted = set(split(t))
            if item is None or not wanted:
                continue
            hit = set()
            for a in range(len(w)):
                for b in range(a + 1, min(a + within, len(w)) + 1):
                    # shortest stretches only
                    if wanted <= set(w[a:b]) and not wanted <= set(w[a + 1 : b]) and not wanted <= set(w[a : b - 1]):
                        hit |= set(range(a, b))
            if hit:
                want.add((doc_id, item, tuple(sorted(hit))))
    rows = pi.proximity(make_docs(docs), frame, within).collect()
    assert {(r.doc_id, r.item_id, tuple(i for s in r.spans for i in range(s.s, s.e))) for r in rows} == want and len(rows) == len(want)


def test_words_of_both_sides_agree(spark):
    texts = ["Hello, WORLD_x 9É", "a b\tc d", "don't stop", "", "İstanbul ſ ẞ", "日本。語"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(pi.tokens(F.col("t"))).collect()] == [[w.decode() for w in pi.words(t.encode())] for t in texts]
