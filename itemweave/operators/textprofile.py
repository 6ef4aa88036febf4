"""Profile and parse delimited text. Inputs are frames with one line per row in ``value``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemweave.functions.columns import split_literal


def profile_delimited(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """One row: lines, total items, fewest and most items of a line, and numeric tokens.

    A line has one item more than delimiters. A numeric token is a field with a digit in it.
    """
    fields = split_literal(F.col("value"), delimiter)
    per_line = lines.select(
        F.size(fields).cast("bigint").alias("items"),
        F.size(F.filter(fields, lambda x: x.rlike("[0-9]"))).cast("bigint").alias("numbers"))
    return per_line.agg(
        F.count(F.lit(1)).alias("lines"), F.sum("items").alias("total_items"),
        F.min("items").alias("min_items"), F.max("items").alias("max_items"),
        F.sum("numbers").alias("numeric_tokens"))


def items_per_line(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """How many lines have how many items."""
    return (lines.select(F.size(split_literal(F.col("value"), delimiter)).cast("bigint").alias("items"))
            .groupBy("items").agg(F.count(F.lit(1)).alias("lines")))


def parse_ints(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """Every non-empty field as a number: leading spaces and sign, then digits up to the first other
    character; a field without leading digits gives 0."""
    field = F.explode(F.filter(split_literal(F.col("value"), delimiter), lambda x: x != ""))
    keep = [c for c in lines.columns if c != "value"]
    digits = F.regexp_extract("field", "^ *([-+]?[0-9]+)", 1)
    return lines.select(*keep, field.alias("field")).select(
        *keep, F.when(digits == "", F.lit(0).cast("bigint")).otherwise(digits.try_cast("bigint")).alias("value"))


def preview(lines: DataFrame, n: int = 2, order: str = "line") -> DataFrame:
    """The first lines by their number (``number_lines``: in the order of files and lines); of a frame without numbers, any."""
    return lines.orderBy(order).limit(n) if order in lines.columns else lines.limit(n)
