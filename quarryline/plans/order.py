"""Positions and running totals in one order over all rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.runtime import written

_LOW = (1 << 33) - 1


def _placed(df: DataFrame, order: list[Column | str], label: str) -> DataFrame:
    """(row, place): range-partitioned and sorted; the upper bits of ``place`` are the partition, the lower ones the position in it.

    Written out, since a range partitioning drawn anew could place rows differently.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place")), label)


def _offsets(totals: DataFrame) -> DataFrame:
    """(part, ahead, total) from (part, own): one row per partition of a sort, whatever the data."""
    ahead = F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return F.broadcast(totals.select("part", ahead.alias("ahead"), F.sum("own").over(Window.partitionBy()).alias("total")))


def positions(df: DataFrame, *order: Column | str, label: str = "ordered") -> DataFrame:
    """(row, at, total): each row of ``df`` as a struct, its position from 0 in the order, and the number of rows."""
    placed = _placed(df, list(order), label)
    part = F.shiftright("place", 33)
    offsets = _offsets(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("own")))
    return placed.withColumn("of", part).join(offsets, F.col("of") == F.col("part")).select("row", (F.col("ahead") + F.col("place").bitwiseAND(F.lit(_LOW))).alias("at"), "total")


def running_totals(df: DataFrame, amount: str, *order: Column | str, label: str = "ordered") -> DataFrame:
    """(row, before, total): the sum of ``amount`` over the rows that come before in the order, and over all rows."""
    placed = _placed(df, list(order), label).withColumn("of", F.shiftright("place", 33)).withColumn("amount", F.col(f"row.{amount}"))
    offsets = _offsets(placed.groupBy(F.col("of").alias("part")).agg(F.sum("amount").alias("own")))
    inside = F.coalesce(F.sum("amount").over(Window.partitionBy("of").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("inside", inside).join(offsets, F.col("of") == F.col("part")).select("row", (F.col("ahead") + F.col("inside")).alias("before"), "total")
