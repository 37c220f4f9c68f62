"""Places and running sums over whole tables and very large groups, without a task that holds all of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.staging import staged


def running(rows: DataFrame, order: list[Column], group: tuple[str, ...] = (), value: Column | int = 1, name: str = "place") -> DataFrame:
    """`rows` with `name`: the sum of `value` over the rows of the same group up to each, itself included, in `order`.

    Rows are range-partitioned by group and order, so a large group lies in many partitions next to each other; the sums of
    each group in each partition are few, and those of the partitions before are added to the sums inside. Nulls are a group.
    `order` should part all rows of a group: rows that it does not part stay in one partition, in any order."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.withColumn("__value", F.lit(value) if isinstance(value, int) else value).repartitionByRange(parts, *group, *order)
    cut = staged(cut.withColumn("__part", F.spark_partition_id()), "ranges")
    sums = cut.groupBy(*group, "__part").agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = sums.select(*(F.col(g).alias(f"__{g}") for g in group), F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("__part") == F.col("__p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    placed = cut.withColumn("__own", F.sum("__value").over(inside)).join(before, same)
    return placed.select(*rows.columns, (F.col("__before") + F.col("__own")).alias(name))


def dense(rows: DataFrame, keys: list[str], name: str = "number") -> DataFrame:
    """`rows` with `name`: 1 for the first distinct `keys`, in their order, 2 for the next, and so on; nulls come first."""
    distinct = running(rows.select(*keys).distinct(), [F.col(k) for k in keys], name=name)
    renamed = distinct.select(*(F.col(k).alias(f"__{k}") for k in keys), name)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(renamed, same).select(*rows.columns, name)
