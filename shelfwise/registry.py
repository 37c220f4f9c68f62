"""The registered queries of the catalogue engine and their DuckDB equivalents, from one record each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "dup_keepers"


def query(sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame under its name, with the SQL that DuckDB runs for the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from shelfwise.queries import catalogue, checks, clusters, curation, duplicates, episodes, intake, journals, names, planning, rules, scoring  # noqa: E402, F401
