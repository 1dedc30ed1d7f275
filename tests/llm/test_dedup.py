"""Operators that compare documents, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seriesloom.llm import exact_dedup, line_dedup, simhash, suffix_dedup
from seriesloom.llm.common import Scratch, table
from seriesloom.llm.components import connected
from seriesloom.llm.runs import SortedRuns
from tools.check import connect, difference

SF = "/root/testdata/sf0.001"


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op3_quality_rules", "op10_line_dedup", "op11_hard_negatives", "op12_collocations", "op13_decontaminate"])
def test_against_sql(spark, name):
    mine = entry.queries()[name](spark, SF).toPandas()
    assert difference(mine, connect(SF).execute(entry.oracle_sql()[name]).df()) is None


def test_all_operators_are_registered():
    numbers = [m[1] for q in entry.queries() if (m := re.match(r"op(\d+)_", q))]
    assert sorted(map(int, numbers)) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, make_docs, odd_pairs, weak):
    """With a weak identifier nearly all chunks collide, and the ranks must tell them apart."""
    long = "".join(random.Random(3).choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(9000))
    pairs = odd_pairs + [(20, long), (21, long[:-1] + "!"), (22, long.upper()), (23, long + " "), (24, "X" + long[1:])]
    identifier = (lambda c: F.length(c) % 3) if weak else F.xxhash64
    rows = exact_dedup.decide(make_docs(pairs), identifier).collect()
    groups = defaultdict(list)
    for i, t in pairs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = sorted((i or 0, min(groups[b])[3] or 0, len(groups[b]), sha(b.encode())) for i, t in pairs for b in [re.sub(r"[\x20\x09-\x0D]", "", t or "")])
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)


def test_rows_kept(spark, make_docs, odd_pairs):
    docs = make_docs(odd_pairs)
    kept = exact_dedup.keep_rows(docs)
    assert kept.columns == docs.columns
    # two long texts are equal, and so are null, empty and blank ones
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda i: i or 0)
    assert ids == [3, 5, 6, 7, 9, 10, 11, 12]
    near = simhash.keep_rows(docs)
    assert near.columns == docs.columns
    texts = [r.text for r in near.collect()]
    assert len(set(texts)) == len(texts)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    roots = brute_components(prints)
    found = entry.queries()["op5_simhash"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {i: (f"{p:016x}", roots[i]) for i, p in prints.items()}


def brute_components(prints):
    roots = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if roots[a] != roots[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    roots[a] = roots[b] = min(roots[a], roots[b])
                    changed = True
    return roots


def test_simhash_odd_rows(spark, make_docs, odd_pairs):
    rows = simhash.group(make_docs(odd_pairs)).collect()
    assert len(rows) == len(odd_pairs)
    blank = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert {r.fp for r in blank} == {0} and {r.component_id for r in blank} == {1}
    assert {r.component_id for r in rows if r.doc_id in (7, 8)} == {7}
    assert simhash.group(make_docs([])).collect() == []


@pytest.mark.parametrize("neighbours", [0, 8])
def test_no_link_is_lost(spark, monkeypatch, neighbours):
    """Dense clouds of fingerprints and chains through them; without sorted links the ring finds all of them."""
    monkeypatch.setattr(simhash, "NEIGHBOURS", neighbours)
    rng = random.Random(9)
    prints, centres = set(), [rng.getrandbits(64) for _ in range(12)]
    for c in centres:
        for _ in range(40):
            p = c
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5, 8])):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(s, s) for s in signed], "fp long, root long")
    scratch = Scratch(spark, "t")
    near = simhash.sorted_links(nodes) if neighbours else None
    roots = {s: s for s in signed}
    if near is not None:
        roots |= {r.node: r.root for r in connected(scratch.write(near, "near"), scratch, "a").collect()}
    labelled = spark.createDataFrame([(s, roots[s]) for s in signed], "fp long, root long")
    links = [(r.a, r.b) for r in simhash.pigeonring_links(labelled, scratch).collect()]
    found = {s: roots[s] for s in signed}
    for _ in range(len(signed)):
        moved = False
        for a, b in links:
            if found[a] != found[b]:
                low, high = sorted((found[a], found[b]))
                found = {k: low if v == high else v for k, v in found.items()}
                moved = True
        if not moved:
            break
    brute = brute_components(dict(zip(signed, prints)))
    assert len(set(found.values())) == len(set(brute.values()))
    assert all((found[a] == found[b]) == (brute[a] == brute[b]) for a in signed[::7] for b in signed)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)] + [(500, 501), (501, 500)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    roots = {x: x for e in edges for x in e}
    for _ in range(len(roots)):
        for a, b in edges:
            roots[a] = roots[b] = min(roots[a], roots[b])
    assert got == roots


def brute_cut(pairs):
    texts = [(t or "").encode() for _, t in pairs]
    counts = Counter(t[p : p + 200] for t in texts for p in range(len(t) - 199))
    out = []
    for (i, _), t in zip(pairs, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - 199):
            if counts[t[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((i or 0, len(t), sum(gone), spans, bytes(x for x, g in zip(t, gone) if not g)))
    return sorted(out)


def cut_of(docs):
    return sorted((r.rest.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.cut(docs).collect())


@pytest.mark.parametrize("slice_size", [1 << 19, 97])
def test_cut_against_brute_force(spark, make_docs, monkeypatch, slice_size):
    monkeypatch.setattr(suffix_dedup, "SLICE", slice_size)
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (150, 199, 200, 201, 260, 400, 900)]
    pairs = []
    for i in range(60):
        noise = lambda: "".join(rng.choice("klmnop") for _ in range(rng.randrange(0, 60)))
        pairs.append((i, "".join(noise() + rng.choice(pool)[rng.randrange(0, 40) :] for _ in range(rng.randrange(0, 4))) + noise()))
    pairs += [(70, "z" * 450), (71, "z" * 210), (72, "xy" * 300), (73, None), (73, pairs[3][1]), (None, pairs[3][1]), (3, pairs[3][1]), (74, "q" * 200), (75, "abc" * 66 + "ab")]
    assert cut_of(make_docs(pairs)) == brute_cut(pairs)


def test_cut_odd_rows(spark, make_docs, odd_pairs):
    docs = make_docs(odd_pairs)
    assert cut_of(docs) == brute_cut([p for p in odd_pairs])
    rows = suffix_dedup.cut_rows(docs)
    assert rows.columns == docs.columns and dict(rows.dtypes) == dict(docs.dtypes)
    assert {r.doc_id: (r.text, r.n_chars) for r in rows.collect()}[7] == ("", 0)
    assert suffix_dedup.cut(make_docs([])).collect() == []


def test_cut_query(spark):
    texts = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    found = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in entry.queries()["op6_suffix_dedup"](spark, SF).collect())
    assert found == [(*row[:4], sha(row[4])) for row in brute_cut(texts)]


def test_lines_odd_rows(spark, make_docs, odd_pairs):
    line = "A line that is long enough to count"
    pairs = odd_pairs + [(30, f"{line}\nshort\n{line.upper()} "), (31, line), (32, f"x\n{line}\n{line}"), (33, "short"), (None, line)]
    rows = {r.doc_id: r for r in line_dedup.strip_lines(make_docs(pairs)).collect()}
    assert (rows[30].n_lines, rows[30].n_dropped, rows[30].kept_text) == (3, 2, "short")
    assert (rows[31].n_dropped, rows[31].kept_text) == (1, "")
    assert rows[32].n_dropped == 0 and rows[33].kept_text == "short" and rows[2].n_lines == rows[1].n_lines == 1
    assert line_dedup.strip_lines(make_docs([])).collect() == []


def test_runs_merge_by_level(spark):
    runs = SortedRuns(spark, Scratch(spark, "t"))
    for batch in range(5):
        runs.add(spark.range(40).selectExpr("id % 10 k1", f"id % (3 + {batch}) k2", "1L n", f"id + {batch} top"))
        assert sorted((level for level, _ in runs.levels), reverse=True) == [level for level, _ in runs.levels]
    assert [level for level, _ in runs.levels] == [2, 0]
    want = Counter((i % 10, i % (3 + b)) for b in range(5) for i in range(40))
    assert {(r.k1, r.k2): r.n for r in runs.totals().collect()} == dict(want)
    runs.close()


def test_exploded_sides_are_not_broadcast(spark, make_docs, odd_pairs, monkeypatch):
    """Spark sizes an exploded table by the rows before the explode, so any of them would look small enough here."""
    plans, write = {}, Scratch.write
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def seen(scratch, df, name):
        plans[name] = plan_of(df)
        return write(scratch, df, name)

    monkeypatch.setattr(Scratch, "write", seen)
    # the joins after the explodes, and none before them that could hide a broadcast
    plans["group"] = plan_of(simhash.group(make_docs(odd_pairs)))
    plans["decide"] = plan_of(exact_dedup.decide(make_docs(odd_pairs)))
    plans["links"] = plan_of(simhash.pigeonring_links(spark.createDataFrame([(1, 1), (3, 3)], "fp long, root long"), Scratch(spark, "t")))
    for name in ("lookups", "group", "decide", "links"):
        assert "SortMergeJoin" in plans[name] and "Broadcast" not in plans[name], name
