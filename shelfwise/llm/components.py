"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import graph


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, component) of every id in the links (a, b) that links with another; component is the smallest id in reach."""
    return graph.components(links.select(F.col("a").cast("long"), F.col("b").cast("long")), rows)
