"""Readers for transaction text, long Parquet, frames with list columns and wide files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemweave.functions.columns import aligned_pairs, split_items, split_literal, trim_trailing
from itemweave.operators.dictionary import require_columns
from itemweave.plans.numbering import number_lines
from itemweave.plans.storage import Workspace


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines as ``value``, with the file split each came from for numbering."""
    return (spark.read.text(path)
            .select("value", F.col("_metadata.file_path").alias("_file"),
                    F.col("_metadata.file_block_start").alias("_block"))
            .where(F.btrim("value", F.lit(" \t\r\n")) != ""))


def read_crisp_text(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """``(txn_id, items)`` from lines of separated items; anything after a ``:`` is ignored."""
    lines = read_lines(spark, path).withColumn("value", F.get(F.split("value", ":", 2), F.lit(0)))
    items = split_items(F.col("value"), sep)
    return number_lines(lines, "txn_id").select("txn_id", items.alias("items"))


def read_fuzzy_text(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """``(txn_id, items, values)`` from ``i1<sep>i2:v1<sep>v2`` lines, values as text.

    Lines without a ``:`` are no transactions and take no id. The lists are kept as written;
    :func:`fuzzy_long` pairs them.
    """
    lines = read_lines(spark, path).where(F.col("value").contains(":"))
    parts = F.split("value", ":", 2)

    def cells(i: int):
        return F.transform(split_literal(trim_trailing(F.get(parts, F.lit(i)), sep), sep),
                           lambda x: F.btrim(x, F.lit(" \t\r\n")))

    return number_lines(lines, "txn_id").select("txn_id", cells(0).alias("items"), cells(1).alias("values"))


def crisp_long(df: DataFrame) -> DataFrame:
    """``(txn_id, item)`` from a list column."""
    return df.select("txn_id", F.explode("items").alias("item")).where(F.col("item") != "")


def fuzzy_long(df: DataFrame, value_type: str = "bigint", on_mismatch: str = "truncate") -> DataFrame:
    """``(txn_id, pos, item, prob)`` from two aligned list columns.

    A value that is no number of ``value_type`` is an error.
    """
    rows = df.select("txn_id", F.posexplode(aligned_pairs(F.col("items"), F.col("values"), on_mismatch)).alias("pos", "c"))
    return (rows.where((F.col("c.item") != "") & F.col("c.value").isNotNull())
            .select("txn_id", "pos", F.col("c.item").alias("item"), F.col("c.value").cast(value_type).alias("prob")))


def read_crisp_parquet(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    require_columns(df, "item", "txn_id")
    return df.select(F.col("txn_id").cast("bigint").alias("txn_id"), F.col("item").cast("string").alias("item"))


def read_fuzzy_parquet(spark: SparkSession, path: str, value_type: str | None = None) -> DataFrame:
    """``(txn_id, item, prob)``. Whole-number memberships become BIGINT, others DOUBLE.

    A pandas index column ``__index_level_0__`` stands in for a missing ``txn_id``; ids that start at
    0 are then moved to start at 1.
    """
    df = spark.read.parquet(path)
    require_columns(df, "item", "prob")
    if "txn_id" not in df.columns:
        if "__index_level_0__" not in df.columns:
            raise ValueError("missing required columns: ['txn_id']")
        low = df.agg(F.min("__index_level_0__")).first()[0]
        df = df.withColumn("txn_id", F.col("__index_level_0__") + F.lit(1 if low == 0 else 0))
    if value_type is None:
        kind = df.schema["prob"].dataType
        whole = isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0)
        value_type = "bigint" if whole else "double"
    return df.select(F.col("txn_id").cast("bigint").alias("txn_id"), F.col("item").cast("string").alias("item"),
                     F.col("prob").cast(value_type).alias("prob"))


def from_lists(df: DataFrame, transactions: str = "Transactions", values: str = "fuzzyValues") -> DataFrame:
    """Long table from a frame with one list of items and (optionally) one of memberships per row.

    ``txn_id`` must be a column when ids matter; otherwise each row gets a unique one.
    """
    if "txn_id" not in df.columns:
        # Written once: computed again, the same row might get another id.
        df = Workspace(df.sparkSession).write(df.withColumn("txn_id", F.monotonically_increasing_id() + F.lit(1)), "lists")
    if values not in df.columns:
        return df.select("txn_id", F.explode(transactions).alias("item"))
    zipped = aligned_pairs(F.col(transactions), F.col(values))
    return df.select("txn_id", F.explode(zipped).alias("c")).select(
        "txn_id", F.col("c.item").alias("item"), F.col("c.value").alias("prob"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load_transactions(spark: SparkSession, path: str, fuzzy: bool = False, sep: str = "\t",
                      value_type: str = "bigint", on_mismatch: str = "truncate") -> DataFrame:
    """Long table from a ``.parquet`` path or, with any other ending, from transaction text."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"input not found: {path}")
    if path.rstrip("/").lower().endswith(".parquet"):
        return read_fuzzy_parquet(spark, path) if fuzzy else read_crisp_parquet(spark, path)
    if fuzzy:
        return fuzzy_long(read_fuzzy_text(spark, path, sep), value_type, on_mismatch)
    return crisp_long(read_crisp_text(spark, path, sep))


def read_headered(spark: SparkSession, path: str, usecols: list[str] | None = None, sep: str = ",") -> DataFrame:
    """A delimited file, or folder of files, whose first lines name the columns; ``usecols`` picks some by name."""
    df = spark.read.csv(path, sep=sep, header=True, enforceSchema=False)
    require_columns(df, *(usecols or []))
    return df.select(*[F.col(f"`{c}`") for c in usecols or df.columns])


def read_wide(spark: SparkSession, path: str, width: int | None = None, sep: str = ",", dtype: str = "string",
              usecols: list[int] | None = None, line_ids: bool = False) -> DataFrame:
    """A headerless delimited file as columns ``c0 .. c{width-1}``; missing cells are NULL.

    The widest line sets the width; a smaller ``width`` is an error. ``line_ids`` adds ``line_id``
    from 0 in line order.
    """
    widest = spark.read.text(path).agg(F.max(F.size(split_literal(F.col("value"), sep)))).first()[0] or 1
    if width is not None and width < widest:
        raise ValueError(f"a line has {widest} cells, more than width={width}")
    width = width or widest
    schema = ", ".join(f"c{i} {dtype}" for i in range(width))
    df = spark.read.csv(path, schema=schema, sep=sep, header=False)
    wanted = [f"c{i}" for i in (usecols if usecols is not None else range(width))]
    if not line_ids:
        return df.select(*wanted)
    marked = df.select(*wanted, F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.file_block_start").alias("_block"))
    return number_lines(marked, "line_id", first=0)
