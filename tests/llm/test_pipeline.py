"""The pipeline's stages work on what the one before has kept, and their decisions take effect."""

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline

FOLDER = "/root/testdata/sf0.01"


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name in ("toxicity", "minhash_near_dedup"):
            assert seen[-1] * 0.6 < docs.count() < seen[-1]
        if name == "suffix_array_dedup":
            assert docs.count() == seen[-1]
        seen.append(docs.count())
    packed = docs.groupBy("sequence_id").agg({"length": "sum"}).toPandas()
    assert packed["sum(length)"].max() <= 4096 and np.mean(packed["sum(length)"]) > 3500


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("which", ["odd_docs", "no_docs"])
def test_pipeline_over_odd_and_empty_tables(spark, which, request, tmp_path):
    """Null ids, texts and sources, repeated rows and clashing column names go through; toxic or doubled ones may go."""
    docs = request.getfixturevalue(which)
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "minhash_near_dedup":
            assert docs.count() <= n
    assert "sequence_id" in docs.columns and (docs.count() > 0) == (n > 0)
