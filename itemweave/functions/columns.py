"""Small column expressions. Everything here is JVM-side; nothing touches rows in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quoted(sep: str) -> str:
    """``sep`` as a literal inside a Java regular expression."""
    return "".join("\\" + c if not c.isalnum() else c for c in sep)


def trim_trailing(col: Column, sep: str) -> Column:
    """Drop separators, line ends and spaces at the end of a line."""
    return F.regexp_replace(col, f"(?:{_quoted(sep)}|[\\r\\n ])+$", "")


def split_literal(col: Column, sep: str) -> Column:
    """Split on ``sep`` taken literally (``|`` and ``.`` are not patterns)."""
    return F.split(col, _quoted(sep))


def split_items(col: Column, sep: str) -> Column:
    """Trailing separators off, split, each item trimmed, empty items dropped."""
    parts = F.transform(split_literal(trim_trailing(col, sep), sep), lambda x: F.btrim(x, F.lit(" \t\r\n")))
    return F.filter(parts, lambda x: x != "")


def aligned_pairs(items: Column, values: Column, on_mismatch: str = "truncate") -> Column:
    """Pair two lists by position as ``array<struct<item, value>>``.

    ``truncate`` keeps the common length, ``skip`` gives an empty list for a line whose lists
    differ in length, ``error`` raises for such a line.
    """
    zipped = F.arrays_zip(items.alias("item"), values.alias("value"))
    common = F.slice(zipped, F.lit(1), F.least(F.size(items), F.size(values)))
    if on_mismatch == "truncate":
        return common
    same = F.size(items) == F.size(values)
    if on_mismatch == "skip":
        return F.when(same, common).otherwise(F.slice(zipped, F.lit(1), F.lit(0)))
    if on_mismatch == "error":
        message = F.concat(
            F.lit("item and value lists differ in length: "),
            F.size(items).cast("string"), F.lit(" items, "),
            F.size(values).cast("string"), F.lit(" values"),
        )
        # Guard the array itself, so that no projection can drop the check.
        return F.when(same, common).otherwise(F.raise_error(message).cast(
            "array<struct<item:string,value:string>>"))
    raise ValueError(f"on_mismatch must be truncate, skip or error, not {on_mismatch!r}")


def itemset_text(items: Column, sep: str = ",") -> Column:
    return F.array_join(items, sep)


def trimmed_mean(col: Column) -> Column:
    """Mean without the smallest and the largest value; the plain mean below three values.

    Written with sum, count, min and max only, so Spark combines it before the shuffle and no
    group is ever collected into a list.
    """
    n = F.count(col)
    return F.when(n >= 3, (F.sum(col) - F.min(col) - F.max(col)) / (n - 2)).otherwise(F.avg(col))


def next_power_of_two(n: Column) -> Column:
    """The smallest power of two that is not below ``n``; NULL below 1."""
    return F.when(n >= 1, F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("bigint"))


def human_bytes(col: Column, digits: int = 1) -> Column:
    """Bytes as text with a binary unit, one decimal by default: ``1536`` gives ``1.5KiB``."""
    # Unit names in ascending powers of 1024.
    units = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
    value = col.cast("double")
    out = None
    for power, unit in enumerate(units):
        shown = F.concat(F.format_string(f"%.{digits}f", F.bround(value / F.lit(float(1024**power)), digits)), F.lit(unit))
        below = value < F.lit(float(1024 ** (power + 1)))
        out = F.when(below, shown) if out is None else out.when(below, shown) if unit != units[-1] else out.otherwise(shown)
    return out


def megabytes_per_second(n_bytes: Column, seconds: Column) -> Column:
    return n_bytes / F.lit(1024.0 * 1024.0) / F.greatest(seconds, F.lit(1e-12))
