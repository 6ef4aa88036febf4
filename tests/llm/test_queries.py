"""Registered queries on the smallest given tables: against their SQL, or for a result of the contract's columns."""

import os

import pytest

import corpus_pipeline
import verify
from itemweave.llm import queries
from itemweave.llm.common import Scratch, table

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables not there")

COLUMNS = {
    "op3_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op4_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op5_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op6_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op7_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op9_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op10_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op11_conversation_repair": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    "op12_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op13_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
}


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_same_as_sql(spark, name):
    state, _, _, note = verify.compare(spark, verify.connect(SF_DIR), name, SF_DIR)
    assert state == "ok", note


@pytest.mark.parametrize("name", list(COLUMNS))
def test_contract_columns(spark, name):
    out = queries.QUERIES[name](spark, SF_DIR)
    assert out.columns[:len(COLUMNS[name])] == COLUMNS[name]
    if name == "op11_conversation_repair":
        assert out.count() == table(spark, SF_DIR, "conversations").select("conv_id").distinct().count()
    elif name not in ("op4_packing", "op6_html_extraction", "op12_hard_negatives", "op13_warc"):
        assert out.count() == table(spark, SF_DIR, "documents").count()


def test_pipeline_stages(spark):
    scratch, docs = Scratch(spark), table(spark, SF_DIR, "documents")
    columns, left = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.save(stage(spark, docs, SF_DIR), name)
        if k < 4:
            assert docs.columns == columns
            assert 0 < docs.count() <= left
            left = docs.count()
    assert docs.select("doc_id").distinct().count() == left
    assert corpus_pipeline.run(spark, SF_DIR).count() == docs.count()


def test_pipeline_on_no_documents(spark):
    docs = table(spark, SF_DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0 or stage is corpus_pipeline.packing
        if stage is corpus_pipeline.decontamination:
            docs = docs.select("doc_id", "text")
