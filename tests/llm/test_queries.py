"""Every registered query on the smallest tables: columns, types, rows, and the columns that follow from the ids."""

import zlib

import pytest

from alertsieve.llm.common import read
from alertsieve.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"
#: columns of the results, in order (fixed values)
COLUMNS = {
    "op1_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op2_url_rules": "page_id bigint, host string, path string, rule string, verdict string",
    "op3_sentencepiece": "doc_id bigint, n_pieces bigint, ids_crc32 bigint, round_trip boolean",
    "op4_ngram_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op5_token_counts": None,
    "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_benchmark_leaks": None,
    "op8_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_token_output": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op10_license_scan": None,
    "op11_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_source_divergence": "lang string, source string, part string, item string, value bigint, rank int",
    "op13_slot_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "pipeline": "doc_id bigint, lang string, source string, piece_ids array<int>, n_pieces int, round_trip boolean",
}
BY_DOCUMENT = ["op1_lm_scoring", "op3_sentencepiece", "op4_ngram_jaccard", "op5_token_counts", "op6_language_id", "op8_quality_rules", "op9_token_output", "op13_slot_shards"]
FOLDS = {"op1_lm_scoring": lambda r: r % 7 == 2, "op6_language_id": lambda r: r % 5 == 0}


def test_all_are_here():
    assert set(COLUMNS) == set(LLM_QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    df = LLM_QUERIES[name](spark, SF)
    if COLUMNS[name]:
        want = [x.strip() for x in COLUMNS[name].split(", ")]
        assert [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields][: len(want)] == want
    rows = df.collect()
    assert rows
    docs = {r.doc_id: r.text for r in read(spark, SF, "documents").select("doc_id", "text").collect()}
    if name in BY_DOCUMENT:
        assert sorted(r.doc_id for r in rows) == sorted(docs)
    if name in FOLDS:
        assert all(r.held_out == FOLDS[name](zlib.crc32(str(r.doc_id).encode())) for r in rows)
    if name in ("op3_sentencepiece", "pipeline"):
        assert all(r.round_trip for r in rows)
    if name == "op9_token_output":
        start = 0
        for r in sorted(rows, key=lambda r: r.doc_id):
            assert r.start == start
            start += r.n_tokens
    if name == "pipeline":
        assert len({r.doc_id for r in rows}) == len(rows) and {r.doc_id for r in rows} <= set(docs)
