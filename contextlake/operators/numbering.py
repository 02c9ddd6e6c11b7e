"""Consecutive numbers in a given order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextlake.session import cut

#: Fixed value: the bits of a generated id that number the rows of a partition.
_ROW_BITS = 33


def numbered(df: DataFrame, *order: Column | str, start: int = 0, name: str = "number") -> DataFrame:
    """``df``, written as a table, with the place of each row in the given order: start + 1, start + 2, ...

    The rows are sorted in range partitions; the sizes of these, one row for each partition, give where each begins. Rows
    that are equal in ``order`` are numbered in any order.
    """
    table = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    parts = table.groupBy(F.shiftright("_at", _ROW_BITS).alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    placed = table.withColumn("_part", F.shiftright("_at", _ROW_BITS)).join(F.broadcast(begins), "_part")
    place = F.col("_begin") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1) + (1 + start)
    return placed.select(*df.columns, place.cast("bigint").alias(name))
