"""The registered queries: SQL where there is some, whole tables and contract columns everywhere."""
import __spark_entry__ as entry
import pytest
from conftest import SF0001
from hydrolens.llm.queries import QUERIES, SQL
from oracle_harness import compare, duck

COLUMNS = {
    "op1_token_files": "doc_id start n_tokens ids_crc32",
    "op2_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op6_url_filter": "page_id host path rule verdict",
    "op7_html_density": "page_id url text n_chars",
    "op8_fuzzy_hash": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op9_minhash": "doc_id n_shingles component_id kept",
    "op10_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op11_vector_codes": "vec_id code error label_error codebooks_sha256",
    "op12_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op13_fill_middle": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert compare(spark, duck(SF0001), name, SF0001, verbose=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_covers_its_table(spark, name):
    out = entry.queries()[name](spark, SF0001)
    assert set(COLUMNS.get(name, "").split()) <= set(out.columns)
    keys = {"page_id": "pages", "vec_id": "embeddings", "doc_id": "documents"}
    key, table = next((k, t) for k, t in keys.items() if k in out.columns)
    whole = spark.read.parquet(f"{SF0001}/{table}.parquet")
    assert out.select(key).distinct().count() == whole.count() and out.count() >= whole.count()


def test_all_operators_and_the_pipeline_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert "pipeline" in entry.queries()
