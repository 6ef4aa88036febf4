"""Sinks for itemsets, long tables, wide tables and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODECS = ("none", "snappy", "gzip", "zstd", "lz4")


def itemset_lines(itemsets: DataFrame, style: str = "comma") -> DataFrame:
    """Itemsets as one ``value`` text column.

    ``comma``   ``a,b<TAB>support``
    ``tab``     ``a<TAB>b:support``
    ``sorted``  ``a<TAB>b:support`` ordered by number of items, then items, repeats removed
    ``by_text`` ``a<TAB>b:support`` ordered by length of the item text, then the text
    """
    items = F.array_distinct("items")
    support = F.col("support").cast("string")
    tabbed = F.array_join(items, "\t")
    if style == "comma":
        return itemsets.select(F.concat_ws("\t", F.array_join("items", ","), support).alias("value"))
    if style == "tab":
        return itemsets.select(F.concat_ws(":", F.array_join("items", "\t"), support).alias("value"))
    line = F.concat_ws(":", tabbed, support).alias("value")
    if style == "sorted":
        return itemsets.orderBy(F.size("items"), "items").select(line)
    if style == "by_text":
        return itemsets.orderBy(F.length(tabbed), tabbed).select(line)
    raise ValueError(f"style must be comma, tab, sorted or by_text, not {style!r}")


def write_itemsets(itemsets: DataFrame, path: str, style: str = "comma") -> None:
    itemset_lines(itemsets, style).write.text(path)


def codec_name(compression: str | None) -> str:
    name = (compression or "none").lower()
    if name not in CODECS:
        raise ValueError(f"compression must be one of {CODECS}, not {compression!r}")
    return name


def write_long_parquet(df: DataFrame, path: str, compression: str | None = "zstd") -> None:
    """``(txn_id, item[, prob])`` as Parquet."""
    cols = [c for c in ("txn_id", "item", "prob") if c in df.columns]
    df.select(*cols).write.option("compression", codec_name(compression)).parquet(path)


def write_stored(df: DataFrame, table: str, path: str, buckets: int, compression: str | None = "zstd") -> None:
    """``(txn_id, item[, prob])`` as a table for repeated mining: bucketed and sorted by transaction, so that the engine ``stored``
    deduplicates and packs it without a shuffle. Read it with ``spark.table(table)``."""
    cols = [c for c in ("txn_id", "item", "prob") if c in df.columns]
    # One task writes one bucket, or each would write a file for every bucket.
    (df.select(*cols).repartition(buckets, "txn_id").write.format("parquet").option("compression", codec_name(compression))
     .option("path", path).bucketBy(buckets, "txn_id").sortBy("txn_id", "item").saveAsTable(table))


def wide_columns(values: Column, width: int) -> list[Column]:
    """``c0 .. c{width-1}``, NULL past the end of a shorter row."""
    return [F.get(values, F.lit(i)).alias(f"c{i}") for i in range(width)]


def checked_width(rows: DataFrame, width: int | None, values: str = "values") -> int:
    """The number of cells of the widest row; an error if a given width is less."""
    widest = rows.agg(F.max(F.size(values))).first()[0] or 0
    if width is not None and width < widest:
        raise ValueError(f"a row has {widest} cells, more than width={width}")
    return max(width if width is not None else widest, 1)


def write_wide_parquet(rows: DataFrame, path: str, width: int | None = None, compression: str | None = None,
                       values: str = "values") -> None:
    """Columns ``c0 ..`` for all cells of the widest row, or for ``width`` of them."""
    width = checked_width(rows, width, values)
    rows.select(*wide_columns(F.col(values), width)).write.option("compression", codec_name(compression)).parquet(path)


def long_values(rows: DataFrame, row_index: str = "row_index", values: str = "values") -> DataFrame:
    """``(row_index, value)``, one row per cell that is there."""
    return rows.select(F.col(row_index).cast("bigint").alias("row_index"), F.explode(values).alias("value"))


def write_long_values(rows: DataFrame, path: str, compression: str | None = None) -> None:
    long_values(rows).write.option("compression", codec_name(compression)).parquet(path)


def write_ragged_csv(rows: DataFrame, path: str, sep: str = ",", compression: str | None = None,
                     values: str = "values") -> None:
    """One line per row, only the values the row has; plain or gzip."""
    line = F.array_join(F.col(values).cast("array<string>"), sep).alias("value")
    rows.select(line).write.option("compression", codec_name(compression)).text(path)


def write_wide_csv(df: DataFrame, path: str, sep: str = ",", compression: str | None = None) -> None:
    """A wide table as lines without a header; empty cells at the end of a line are left out."""
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    last = F.coalesce(F.array_max(F.transform(cells, lambda x, i: F.when(x.isNotNull(), i + 1))), F.lit(0))
    write_ragged_csv(df.select(F.transform(F.slice(cells, F.lit(1), last), lambda x: F.coalesce(x, F.lit(""))).alias("values")),
                     path, sep, compression)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
