import duckdb
import pytest

from takeledger.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    result = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted(result.fetchall())
    got = sorted(tuple(r[n] for n in names) for r in queries.queries()[name](spark, DATA).collect())
    assert got == want and (len(got) == {"op12_centroid_clusters": 500}.get(name, 200) or name.startswith("op10") and got)


def test_contract_columns(spark):
    need = {
        "op1_toxicity": "doc_id held_out score predicted", "op2_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256", "op3_language_id": "doc_id held_out lang_pred score",
        "op4_token_counts": "doc_id n_bytes n_tokens over_limit", "op5_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score", "op6_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op7_bpe_round_trip": "doc_id n_tokens ids_sha256 decoded_sha256", "op8_nearest_vectors": "query_id rank vec_id score", "op9_jaccard_join": "doc_id class_id n_links", "op10_decontamination": "doc_id item_id",
        "op11_whitening": "vec_id component n deviation whitened explained identity_error", "op12_centroid_clusters": "vec_id cluster distance cluster_inertia inertia centroid_sha256", "op13_simhash": "doc_id fingerprint component_id",
    }
    for name, columns in need.items():
        df = queries.queries()[name](spark, DATA)
        assert set(columns.split()) <= set(df.columns), name
        assert df.count() == {"op8_nearest_vectors": 50, "op11_whitening": 2000, "op12_centroid_clusters": 500}.get(name, df.count() if name.startswith("op10") else 200), name
