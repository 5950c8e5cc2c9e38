"""The pipeline on a small table against brute force where a stage has one."""

import pytest

import corpus_pipeline as cp
from alertsieve.llm.common import lower_words, read


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = read(spark, sf_dir, "documents")
    columns = docs.columns
    kept = None
    for name, stage in cp.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name == "sentence_pieces":
            break
        assert docs.columns == columns, name
        rows = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= set(rows)
        if name == "near_duplicates":
            sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in rows.items() for w in [lower_words(t)]}
            gone = set(rows) - kept
            for i in rows:
                links = [j for j in sets if j != i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
                assert not (i in kept and any(j in kept for j in links)), i
                assert i in kept or links, i
            assert gone
        if name == "benchmark_leaks":
            items = [r.text for r in read(spark, sf_dir, "benchmark").collect()]
            holds = {i for i, t in rows.items() if any(x in t for x in items)}
            assert not holds & kept
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    out = docs.collect()
    assert {r.doc_id for r in out} == kept and all(r.round_trip for r in out)


def test_stages_take_odd_rows(spark):
    schema = read(spark, "/root/testdata/sf0.001", "documents").schema.add("kept", "boolean")
    rows = [(None, None, None, None, None, True), (1, "", "en", None, 0, None), (2, "a b", None, "s", 3, None), (2, "a b", None, "s", 3, None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in cp.STAGES:
            got = stage(spark, docs, "/root/testdata/sf0.001")
            assert name == "sentence_pieces" or got.columns == docs.columns
            assert got.count() <= len(data)


@pytest.mark.parametrize("name", ["op6_language_id"])
def test_held_out_accuracy(spark, name):
    from alertsieve.llm.queries import LLM_QUERIES

    got = LLM_QUERIES[name](spark, "/root/testdata/sf0.01").where("held_out").join(read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got)
