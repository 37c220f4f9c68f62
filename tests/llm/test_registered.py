"""Every registered query with its production parameters, over whole small tables."""

import duckdb
import pytest

from shelfwise.llm import queries

FOLDER = "/root/testdata/sf0.001"
#: The table that a query has a row for each row of, and columns that it must return.
RESULTS = {
    "op1_quality_classifier": ("documents", "doc_id held_out score predicted"),
    "op2_suffix_array_dedup": ("documents", "doc_id n_bytes n_removed n_spans kept_sha256"),
    "op3_toxicity": ("documents", "doc_id held_out score predicted"),
    "op4_chat_formatting": (None, "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars"),
    "op5_embedding_near_dups": ("embeddings", "vec_id n_links component_id kept"),
    "op6_token_counts": ("documents", "doc_id n_bytes n_tokens over_limit"),
    "op7_minhash_near_dups": ("documents", "doc_id class_id kept"),
    "op8_document_fingerprints": ("documents", "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next"),
    "op9_mixing_sources": ("documents", "doc_id size source_size target taken"),
    "op10_best_fit_packing": (None, "doc_id piece start length ids_crc32 sequence_id offset"),
    "op11_nearest_neighbours": (None, "query_id rank vec_id score"),
    "op12_source_divergence": (None, "lang source part item value rank"),
    "op13_vector_codes": ("embeddings", "vec_id code error label_error codebooks_sha256"),
}


def test_all_are_listed():
    assert set(RESULTS) == set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(RESULTS))
def test_runs_over_the_whole_table(spark, name):
    table, columns = RESULTS[name]
    found = queries.QUERIES[name](spark, FOLDER)
    assert set(columns.split()) <= set(found.columns)
    rows = found.count()
    if table:
        assert rows == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    if name == "op4_chat_formatting":
        assert rows == spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id").distinct().count() + 1
        trial = found.where("conv_id = -7").first()
        assert (trial.n_turns, trial.loss_chars) == (2, len("</s>[INST] ok [/INST]"))
    if name == "op11_nearest_neighbours":
        n = spark.read.parquet(f"{FOLDER}/embeddings.parquet").where("vec_id % 20 = 0").count()
        assert rows == 20 * n
    if name in queries.ORACLE_SQL and name == "op9_mixing_sources":
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
        want = con.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in want.description]
        plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
        assert sorted(map(plain, want.fetchall()), key=repr) == sorted((plain(r) for r in found.select(*names).collect()), key=repr)
