"""Periodic frequency: consecutive occurrences of a set that are at most ``max_gap`` ids apart.

Transactions are packed by groups of neighbouring ids, so all occurrences of a candidate in a group are in one task. There they are
folded into 64-id words with ``bit_or``, the gaps inside a word counted with shifts, and the words of the group stitched to one
summary: first and last id, near gaps, support and frequency. All this needs no exchange; what travels is one summary for each
candidate and group. Summaries are stitched in the order of their ids, 1024 groups at a time, until one is left, so no
window partition holds more than 1024 rows however often a set occurs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemweave.operators.dictionary import sum_type
from itemweave.plans.levels import Counting, Support

_WORD_BITS = 6
_GROUP_BITS = 10


def _close_inside_word(bits: Column, max_gap: int) -> Column:
    """How many set bits have another set bit at most ``max_gap`` places below them."""
    if max_gap >= 63:
        return F.bit_count(bits) - F.lit(1)
    near = reduce(Column.bitwiseOR, [F.shiftleft(bits, d) for d in range(1, max_gap + 1)])
    return F.bit_count(bits.bitwiseAND(near))


class PeriodicSupport(Support):
    """Adds ``periodic_freq`` to the totals. Units are transaction ids."""

    carried = ("unit", "grp")

    def __init__(self, counting: Counting, keep: Column, max_gap: int, last_id: int, n_parts: int):
        """Ids run from 0 to ``last_id``; groups are as wide as leaves every partition several of them."""
        super().__init__(counting, keep)
        if max_gap < 1:
            raise ValueError("max_gap must be at least 1")
        self.max_gap, self.last_id = int(max_gap), last_id
        self.shift = max(_WORD_BITS, min(_WORD_BITS + _GROUP_BITS, ((last_id + 1) // (4 * n_parts)).bit_length()))

    def group(self, unit: Column) -> Column:
        return F.shiftright(unit, self.shift)

    def columns(self) -> list[str]:
        return ["support", "freq", "periodic_freq"]

    def totals(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("unit").bitwiseAND(F.lit(63)).cast("int"))
        kind = sum_type(rows.schema["m"].dataType) if self.counting.has_values else "bigint"
        if "grp" not in rows.columns:
            rows = rows.withColumn("grp", self.group(F.col("unit")))
        words = rows.groupBy("grp", *keys, F.shiftright("unit", _WORD_BITS).alias("word")).agg(
            F.bit_or(bit).alias("bits"), F.sum("m").cast(kind).alias("support"),
            F.min("unit").alias("first_id"), F.max("unit").alias("last_id"))
        runs = words.select("grp", *keys, "first_id", "last_id", "support",
                            F.bit_count("bits").cast("bigint").alias("freq"),
                            _close_inside_word(F.col("bits"), self.max_gap).cast("bigint").alias("periodic_freq"))
        runs, shift = self._stitch(runs, keys), self.shift
        while self.last_id >> shift:
            shift += _GROUP_BITS
            runs = self._stitch(runs.withColumn("grp", F.shiftright("first_id", shift)), keys)
        return runs.select(*keys, *self.columns())

    def _stitch(self, runs: DataFrame, keys: list[str]) -> DataFrame:
        previous = F.lag("last_id").over(Window.partitionBy("grp", *keys).orderBy("first_id"))
        joined = runs.withColumn("close", F.coalesce(
            (F.col("first_id") - previous <= self.max_gap).cast("bigint"), F.lit(0).cast("bigint")))
        return joined.groupBy("grp", *keys).agg(
            F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"),
            F.sum("support").cast(runs.schema["support"].dataType).alias("support"), F.sum("freq").alias("freq"),
            (F.sum("periodic_freq") + F.sum("close")).alias("periodic_freq"))
