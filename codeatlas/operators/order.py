"""Places in an order, without one task that sees all rows or all of a large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Table, cut


def numbered(df: DataFrame, order: list[str], within: list[str] | None = None) -> DataFrame:
    """``df`` with ``pos``, from 0: a row's place in ``order`` among the rows of equal ``within``, or among
    all rows.  Rows are dealt by ranges of all these columns, so that a large group spreads over many
    tasks; its ranges' sizes, added up, say where each range begins.  Nulls come first and are a group;
    rows equal in every column of the order are numbered in any order.  An empty table stays empty."""
    within = within or []
    dealt = cut(df.repartitionByRange(*within, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(*within, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_range").alias("_r"), *(F.col(c).alias(f"_w{i}") for i, c in enumerate(within)), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(within):
        same &= F.col(c).eqNullSafe(F.col(f"_w{i}"))
    place = F.row_number().over(Window.partitionBy(*within, "_range").orderBy(*order))
    return dealt.join(starts, same).withColumn("pos", F.col("_start") + place - 1).select(*df.columns, "pos")


#: Bits of a label below the number of its range.
ROW_BITS = 33


def labelled(df: DataFrame, order: list[str | Column], name: str) -> Table:
    """``df`` stored with labels ``name`` that grow with ``order``, but have gaps between its ranges: a
    shuffle and no more."""
    return Table(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))


def closed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``pos``, from 0 and without gaps, by the labels ``name`` of all its rows."""
    ranges = df.select(F.shiftright(name, ROW_BITS).alias("_range"), name)
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")))  # a row a range
    rows = df.withColumn("_range", F.shiftright(name, ROW_BITS)).join(starts, "_range")
    return rows.select(*df.columns, (F.col("_start") + F.col(name).bitwiseAND(F.lit((1 << ROW_BITS) - 1))).alias("pos"))
