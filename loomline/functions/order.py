"""Ranks and running totals over a whole table, without one task seeing all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import checkpointed


def running_total(df: DataFrame, order: list[str], amount: str | None = None, into: str = "upto") -> DataFrame:
    """df with the sum of `amount` (1 without it) over all rows up to and including its own, in the order of the columns.

    Rows are range-partitioned by the order and checkpointed, so that ranges can't change between the two readings. Sums are taken
    inside each range; its offset is the sum of the ranges before it, one row per range. The order should be total.
    """
    each = F.lit(1) if amount is None else F.col(amount)
    rows = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = rows.groupBy("_part").agg(F.sum(each).alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("_part", before.alias("_before"))
    inside = F.sum(each).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_in", inside).join(offsets, "_part").withColumn(into, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """df with `rank` from 0."""
    return running_total(df, list(order), None, "rank").withColumn("rank", F.col("rank") - 1)
