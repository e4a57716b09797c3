"""The registered queries over the smallest tables: columns and types as agreed, and SQL where there is some."""

import os

import pytest

from flowspark.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
TYPES = {
    "op1_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op2_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op3_compact_shards": {"doc_id": "bigint", "version": "bigint", "shard": "string", "row": "bigint", "shard_bytes": "bigint"},
    "op4_binary_ids": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op5_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op6_quality_outliers": {"doc_id": "bigint", **dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "bigint"), "base_failed": "boolean", "kept": "boolean", "fit": "string"},
    "op7_pii_pseudonyms": {"doc_id": "bigint", "text": "string", **dict.fromkeys(("n_found", "n_card", "n_iban", "n_phone", "n_ssn", "n_ipv4", "n_date", "n_email", "n_token"), "bigint")},
    "op8_suffix_repeats": {"doc_id": "bigint", "start": "bigint", "n_words": "bigint"},
    "op9_simhash_groups": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
}


def test_entry_registers_all():
    import __spark_entry__

    assert set(TYPES) == set(queries.QUERIES)
    assert {*TYPES, "pipeline"} <= set(__spark_entry__.queries())
    assert set(queries.ORACLE_SQL) <= set(TYPES)


@pytest.mark.parametrize("name", sorted(TYPES))
def test_query(spark, name):
    import duckdb

    if name in ("op2_token_counts", "op4_binary_ids"):
        pytest.importorskip("public_tokenizers")
    df = queries.QUERIES[name](spark, SF)
    assert dict(df.dtypes) == TYPES[name]
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert name == "op8_suffix_repeats" or len(got) == docs
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        result = con.execute(queries.ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
