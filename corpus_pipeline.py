"""The corpus pipeline: from raw documents to packed sequences."""

from __future__ import annotations

import public_tokenizers

from shelfwise.llm import mixing, near_dups, packing, suffixes, toxicity
from shelfwise.llm.tables import staged, table

#: Distinct pieces of text that a packing worker remembers, where workers of other stages wait beside it.
MEMO = 120_000


def reject_toxic(spark, docs, sf_dir):
    """Documents under the toxicity threshold."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark, docs, sf_dir):
    """One document of each class of near copies: the one with the smallest id."""
    return near_dups.one_of_each(docs)


def cut_repeats(spark, docs, sf_dir):
    """Every document, without the passages that a document with a smaller id has too."""
    return suffixes.without_repeats(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix takes them; at a source's cut, the first words of one."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark, docs, sf_dir):
    """Pieces of documents with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), memo=MEMO)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", keep_one_of_each),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Nearest examples, signatures and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each result but the last written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
