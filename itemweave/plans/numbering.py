"""Dense row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemweave.plans.storage import Workspace

# monotonically_increasing_id keeps the partition number above this bit.
_PARTITION_SHIFT = 33
# Partitions whose rows are summed up by one window.
_RANGE_BITS = 10


def _running(counts: DataFrame, slot: str, value: str) -> DataFrame:
    """``slot`` and ``_before``, the sum of ``value`` in all lower slots, by sums over ranges of 1024 slots."""
    ranged = counts.withColumn("_range", F.shiftright(slot, _RANGE_BITS))
    ranges = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return ranged.join(ranges, "_range").select(slot, (F.col("_base") + F.col("_inside")).alias("_before"))


def _apply_offsets(numbered: DataFrame, name: str, first: int, workspace: Workspace) -> DataFrame:
    keyed = numbered.withColumn("_part", F.shiftright("_mid", _PARTITION_SHIFT))
    counts = keyed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    # Written, so that Spark knows the size of this side when it chooses how to join.
    offsets = workspace.write(_running(counts, "_part", "_rows"), f"offsets-{name}")
    within = F.col("_mid") - F.shiftleft(F.col("_part"), _PARTITION_SHIFT)
    return (keyed.join(offsets, "_part")
            .withColumn(name, (F.col("_before") + within + F.lit(first)).cast("bigint"))
            .drop("_part", "_before", "_mid"))


def number_rows(df: DataFrame, order_by: list[Column], name: str, first: int = 1,
                workspace: Workspace | None = None) -> DataFrame:
    """Add ``name`` = position of the row in the given order, counting from ``first``.

    A range-partitioned sort is written once; each partition then only needs the number of rows
    before it. ``order_by`` must be a total order for the result to be unique.
    """
    workspace = workspace or Workspace(df.sparkSession)
    ordered = df.orderBy(*order_by).withColumn("_mid", F.monotonically_increasing_id())
    return _apply_offsets(workspace.write(ordered, f"ordered-{name}"), name, first, workspace)


def number_lines(df: DataFrame, name: str, first: int = 1,
                 workspace: Workspace | None = None) -> DataFrame:
    """Add ``name`` = line number over all files of a read, in file and line order.

    ``df`` holds ``_file`` and ``_block`` (the path and start of the file split a row came from).
    Splits are packed into partitions by size, not by position, so each split gets its own offset.
    The splits are sorted and numbered themselves, and their offsets summed up by ranges.
    """
    workspace = workspace or Workspace(df.sparkSession)
    marked = workspace.write(df.withColumn("_mid", F.monotonically_increasing_id()), f"lines-{name}")
    splits = marked.groupBy("_file", "_block").agg(
        F.min("_mid").alias("_start"), F.count(F.lit(1)).alias("_rows"))
    splits = workspace.write(number_rows(splits, [F.col("_file"), F.col("_block")], "_split", first=0, workspace=workspace), f"splits-{name}")
    before = _running(splits.select("_split", "_rows"), "_split", "_rows")
    splits = workspace.write(splits.join(before, "_split").select("_file", "_block", "_start", "_before"), f"starts-{name}")
    return (marked.join(splits, ["_file", "_block"])
            .withColumn(name, (F.col("_before") + F.col("_mid") - F.col("_start") + F.lit(first)).cast("bigint"))
            .drop("_file", "_block", "_mid", "_start", "_before"))
