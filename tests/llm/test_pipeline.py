"""The pipeline stage by stage."""

import corpus_pipeline
from seriesloom.llm import exact_dedup, packing, simhash, suffix_dedup
from seriesloom.llm.common import Scratch, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    scratch = Scratch(spark, "t")
    docs = table(spark, SF, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs, (after := scratch.write(stage(spark, docs, SF), name))
        if name != "packing":
            assert dict(after.dtypes) == dict(docs.dtypes)
        docs = after
    ids = {name: {r.doc_id for r in after.select("doc_id").collect()} for name, (_, after) in seen.items()}
    before, after = seen["exact_dedup"]
    assert ids["exact_dedup"] == {r.doc_id for r in exact_dedup.decide(before).where("kept").collect()}
    before, after = seen["simhash"]
    assert ids["simhash"] == {r.doc_id for r in simhash.group(before).collect() if r.doc_id == r.component_id}
    before, after = seen["suffix_dedup"]
    sizes = {r.rest.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.cut(before).collect()}
    rows = after.collect()
    assert ids["suffix_dedup"] == ids["simhash"] and all(r.n_chars == len(r.text) for r in rows)
    assert all(len(r.text.encode()) <= sizes[r.doc_id] for r in rows)
    assert ids["packing"] == ids["suffix_dedup"]
    assert seen["packing"][1].agg({"piece_length": "sum"}).first()[0] == after.select(packing.word_count(after.text).alias("n")).agg({"n": "sum"}).first()[0]


def test_chain_on_odd_and_empty_tables(spark, make_docs, odd_pairs, tmp_path):
    for name, pairs in (("odd", odd_pairs), ("empty", [])):
        folder = str(tmp_path / name)
        docs = make_docs(pairs).withColumnsRenamed({"row": "_kd", "h": "kt"})
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert (len(rows) > 0) == (len(pairs) > 0)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, folder)
            assert after.columns == docs.columns
            assert {r["_kd"] for r in after.collect()} <= {1}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns[:2] == ["doc_id", "piece"]
