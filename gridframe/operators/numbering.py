"""Positions of rows in a total order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridframe.session import cut_lineage

#: Bits of monotonically_increasing_id below the number of the partition.
ROW_BITS = 33


def _placed(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The rows sorted by range partitions and checkpointed, with their place (``_at``) and the number of their partition (``_part``)."""
    return cut_lineage(df.orderBy(*order)).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", ROW_BITS))


def _before(placed: DataFrame, amount: Column) -> DataFrame:
    """(_part, _offset): what the partitions before hold, from one number per partition."""
    sums = placed.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset")))


def numbered(df: DataFrame, order: Sequence[Column | str], out: str = "position") -> DataFrame:
    """Adds the position of each row, from 0, in the given order.

    Spark sorts by range partitions; a row's position is its place inside its partition plus the rows of the partitions before.
    Only one count per partition is summed up. The sorted table is checkpointed, so both passes see the same
    partitions. Rows that the order leaves equal are numbered in any order; a last, row by row different
    term in ``order`` lets Spark split a large group of them.
    """
    placed = _placed(df, order)
    inside = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return placed.join(_before(placed, F.lit(1)), "_part").withColumn(out, F.col("_offset") + inside).drop("_at", "_part", "_offset")


def running_totals(df: DataFrame, order: Sequence[Column | str], amount: str, out: str) -> DataFrame:
    """Adds the sum of a whole-number column over all rows up to and with each one, in the given order, in the same way."""
    placed = _placed(df, order)
    inside = F.sum(amount).over(Window.partitionBy("_part").orderBy("_at"))
    return placed.withColumn("_inside", inside).join(_before(placed, F.col(amount)), "_part").withColumn(out, F.col("_offset") + F.col("_inside")).drop("_at", "_part", "_offset", "_inside")


def dense_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Distinct (keys, value) with the rank of the value, from 0, among those of its keys. NULL values are left out."""
    distinct = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    placed = numbered(distinct, [*keys, value], "_position")
    first = placed.groupBy(*keys).agg(F.min("_position").alias("_first"))
    return placed.join(first, [*keys]).select(*keys, value, (F.col("_position") - F.col("_first")).cast("int").alias(out))
