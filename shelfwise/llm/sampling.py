"""Bounded samples of labelled documents, for fitting."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def crc_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int) -> pd.DataFrame:
    """(doc_id, text, label) of at most `max_rows` labelled documents, the first in an order by hash of the id, on the
    driver. `usable` says which ids may be learnt from. Null and contradicting labels are left out; of an id with several
    texts, the one that sorts first stands for it."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("top"))
    ids = known.where("label = top").select("doc_id", "label").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    found = found.toPandas().sort_values("doc_id", ignore_index=True)  # max_rows rows at most
    found["label"] = (found["label"].astype("int64") > 0).astype("int64")
    return found
