"""Collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from seriesloom.llm import collocations as co


def brute(docs, least, top):
    found, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, 6):
                found[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in found.items():
        n, rows = total[lang], []
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {q for p, b in held.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) for q in [p[i : i + m]] if 100 * b >= 100 * f[q]}
        for p, a in held.items():
            if p not in inside:
                score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, n, -score) for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def frame(spark, docs):
    rows = [(i, t, lang, 1, "x", None) for i, (lang, t) in enumerate(docs)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, phrase string, range int")


def corpus():
    rng = random.Random(11)
    vocabulary = ["the"] * 40 + ["Of", "AND", "to"] * 12 + [f"w{i}" for i in range(60)] + ["é", "日本", "x y", "\x00z", "İ"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "!? "]
    docs = []
    for i in range(150):
        lang = rng.choice(["en", "en", "en", "de", None])
        text = "".join(rng.choice(vocabulary) + rng.choice(ends) for _ in range(rng.randrange(0, 150)))
        docs.append((lang, text + "one very common line of words" * (i % 3 == 0)))
    return docs + [(None, None), ("fr", ""), ("fr", " \t.\n"), ("en", "buy now " * 400), ("two words", "a b " * 9)]


def test_against_brute_force(spark, monkeypatch):
    docs = corpus()
    want = {(least, top): brute(docs, least, top) for least, top in ((8, 2000), (2, 7))}
    for chunk, span in ((200, 100), (1 << 21, 1 << 21)):
        monkeypatch.setattr(co, "CHUNK_WORDS", chunk)
        monkeypatch.setattr(co, "RANGE_WORDS", span)
        for (least, top), rows in want.items():
            assert collected(co.collocations(frame(spark, docs), least, top)) == rows


def test_empty_and_wordless(spark):
    assert collected(co.collocations(frame(spark, []))) == []
    assert collected(co.collocations(frame(spark, [("en", None), (None, " . ")]))) == []


def test_slices_unite_to_the_whole():
    chunk = co.Chunk()
    for lang, text in corpus():
        chunk.add((lang or "und").encode(), (text or "").encode())
    columns, terms, langs = chunk.windows()
    whole = Counter((langs[r[0] - 1], *(terms[x - 1] for x in r[1:] if x)) for r in np.stack(columns, axis=1).tolist())
    bounds = [(b"de", b"the"), (b"en",), (b"en", b"nowhere"), (b"en", b"the", b"the", b"of"), (b"und", b"zz")]
    rows = [r for batch in chunk.slices(bounds) for r in batch.to_pylist()]
    assert [r["range"] for r in rows] == sorted(r["range"] for r in rows) and len(rows) > 4
    united, terms, langs = co.unite(rows + rows)
    found = {(langs[r[0] - 1], *(terms[x - 1] for x in r[1:] if x)): w for *r, w in np.stack([*united.columns, united.weight], axis=1).tolist()}
    assert found == {k: 2 * v for k, v in whole.items()}
    at, weight = united.states(0)
    assert weight.sum() == 2 * sum(whole.values()) and len(at) == len({k[0] for k in whole})
