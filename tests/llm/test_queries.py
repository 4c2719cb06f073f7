"""The registered queries: columns of the contracts, and SQL where there is some."""

import time
from pathlib import Path

import duckdb
import pytest

from larkspur.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op2_huffman_ids": "doc_id start n_tokens ids_crc32",
    "op3_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op4_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op5_near_duplicates": "doc_id fingerprint component_id",
    "op6_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op7_toxicity": "doc_id held_out score predicted",
    "op8_interleaved_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op9_repeated_substrings": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op10_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op11_importance_resampling": "doc_id n_features weight score rank",
    "op12_embedding_links": "vec_id n_links component_id kept",
    "op13_spelling_variants": "word form root n n_near form_n",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    if "doc_id" in df.columns:
        assert df.count() >= spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    else:
        assert not df.isEmpty()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    began = time.time()
    result = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    want = sorted(map(str, result.fetchall()))
    assert time.time() - began < 120
    got = sorted(str(tuple(r)) for r in QUERIES[name](spark, sf_dir).select(*names).collect())
    assert got == want
