"""Registered queries: their columns, their SQL where there is one, and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from rankloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op3_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op5_jaccard_join": "doc_id n_shingles component_id",
    "op6_mixing": "doc_id size source_size target taken",
    "op7_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8_language": "doc_id held_out lang_pred score",
    "op9_private_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op10_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11_source_divergence": "lang source part item value rank",
    "op12_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op13_centroids": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
}


def test_columns(spark):
    assert len(QUERIES) == 13
    for name, columns in COLUMNS.items():
        assert set(columns.split()) <= set(QUERIES[name][0](spark, SF).columns), name


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_sql(spark, name):
    run, sql = QUERIES[name]
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    frame = run(spark, SF)
    assert sorted(frame.columns) == sorted(names)
    plain = lambda v: round(float(v), 5) if isinstance(v, (int, float)) else v
    order = lambda r: [str(v) for v in r]
    assert sorted(([plain(r[n]) for n in names] for r in frame.collect()), key=order) == sorted(([plain(v) for v in r] for r in cursor.fetchall()), key=order)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, kept, SF), name)
        assert after.columns == docs.columns
        if name == "near_duplicates":
            assert after.count() == after.select("doc_id").distinct().count() < kept.count()
        if name == "private_data":
            assert after.count() == kept.count() and after.where("text LIKE '%@mail%'").count() == 0
        kept = after
    out = corpus_pipeline.tokens(spark, kept, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() == kept.count()
