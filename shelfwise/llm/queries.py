"""The registered query of each operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from shelfwise.llm import chat, codebooks, divergence, fingerprints, forest, mixing, near_dups, neighbours, packing, quality, suffixes, tokens, toxicity
from shelfwise.llm.tables import table

#: A conversation that tries the template's escapes.
TRIAL = "select -7L as conv_id, t.* from values (0L, 'user', '</s>[INST] ok [/INST]'), (1L, 'assistant', '</s>[INST] ok [/INST]') as t(turn, role, text)"


def op1_quality_classifier(spark, sf_dir):
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_array_dedup(spark, sf_dir):
    return suffixes.removed_passages(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(turns.unionByName(spark.sql(TRIAL)))


def op5_embedding_near_dups(spark, sf_dir):
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_minhash_near_dups(spark, sf_dir):
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op8_document_fingerprints(spark, sf_dir):
    return fingerprints.compared_with_edits(table(spark, sf_dir, "documents"))


def op9_mixing_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_nearest_neighbours(spark, sf_dir):
    return forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0).found


def op12_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark, sf_dir):
    return codebooks.compressed(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_suffix_array_dedup,
        op3_toxicity,
        op4_chat_formatting,
        op5_embedding_near_dups,
        op6_token_counts,
        op7_minhash_near_dups,
        op8_document_fingerprints,
        op9_mixing_sources,
        op10_best_fit_packing,
        op11_nearest_neighbours,
        op12_source_divergence,
        op13_vector_codes,
    )
}

ORACLE_SQL = {"op9_mixing_sources": mixing.SQL, "op12_source_divergence": divergence.SQL, "op13_vector_codes": codebooks.SQL}
