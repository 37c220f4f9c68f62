"""Tables of a folder, and staged tables in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.operators.staging import drop, remove, shared_dir, staged

__all__ = ["drop", "remove", "shared_dir", "staged", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
