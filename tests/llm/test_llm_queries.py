"""The registered queries: those with SQL against it, the others for their contract's columns."""

from __future__ import annotations

import pytest
from oracle import database, differences

from svlake.llm.queries import QUERIES, SQL

COLUMNS = {
    "op1_quality": {"doc_id", "kept"}, "op2_licences": {"doc_id", "families"}, "op3_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op4_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op5_compaction": {"doc_id", "shard"}, "op6_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op7_mixing": {"doc_id", "size", "source_size", "target", "taken"}, "op8_decontaminate": {"doc_id", "item_id"},
    "op9_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"}, "op10_hilbert_ann": {"query_id", "rank", "vec_id", "score"},
    "op11_periodic_runs": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    "op12_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op13_filter_audit": {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"},
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), database(sf_dir), SQL[name]) == ""


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(COLUMNS) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(SQL)))
def test_columns_and_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert COLUMNS[name] <= set(df.columns)
    assert df.limit(1).count() == 1
