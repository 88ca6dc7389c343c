"""Running sums and places over a whole ordered table, without one task for all of it.

The order is cut into blocks; each block is summed by itself, the blocks' totals
are summed before it, and only those few totals meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.sources.staging import stored

# Most distinct values of a whole-number order in one block.
BLOCK = 1 << 20


def in_ranges(frame: DataFrame, order: list[str], to: str = "__block") -> DataFrame:
    """``frame`` stored in ranges of ``order``, with the number of its range.

    It is stored so that a range can't be dealt otherwise when it is read again.
    """
    return stored(frame.repartitionByRange(*order).withColumn(to, F.spark_partition_id()))


def running_sum(frame: DataFrame, order: list[str], amount: Column, to: str, block: Column | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``to``: the sum of ``amount`` up to and including each row, as a bigint.

    ``block`` must never fall along ``order``; without it the first column of
    ``order`` is a whole number and is cut by its value.  ``within`` sums groups
    apart.  Rows that tie in ``order`` follow one another in any order; a null
    amount counts as 0; nulls in ``order`` come first, in a block of their own.
    """
    cut = F.floor(F.col(order[0]) / BLOCK) if block is None else block
    held = frame.withColumn("__block", cut).withColumn("__amount", F.coalesce(amount, F.lit(0)).cast("bigint"))
    keys = [*within, "__block"]
    totals = held.groupBy(*keys).agg(F.sum("__amount").alias("__total"))
    earlier = Window.partitionBy(*within).orderBy(F.col("__block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*(F.col(k).alias(f"__of{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__of{i}"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = held.withColumn("__inside", F.sum("__amount").over(inside)).join(before, same)
    return summed.withColumn(to, F.col("__inside") + F.col("__before")).drop("__block", "__amount", "__inside", "__before", *(f"__of{i}" for i in range(len(keys))))


def numbered(frame: DataFrame, order: list[str], to: str, block: Column | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``to``: each row's place in ``order``, from 0."""
    return running_sum(frame, order, F.lit(1), to, block, within).withColumn(to, F.col(to) - 1)
