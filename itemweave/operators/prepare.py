"""Dataset preparation: fixed point, text conversion and replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemweave.operators.dictionary import require_columns
from itemweave.sources import readers, writers


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_PARSED = ("__text", "__mantissa", "__exponent", "__fraction", "__digits", "__point")


def _parsed(df: DataFrame, col: str) -> DataFrame:
    """Add the digits of numbers of any length without the point, its place among them, and the digits behind it as written.

    Each step is a column of its own, or Spark would work the text out again in every branch that uses it.
    """
    text = F.btrim(F.col(col).cast("string"))
    # Numbers are well-formed but for NaN and the infinities.
    fine = F.regexp_like(text, F.lit(_NUMBER)) if isinstance(df.schema[col].dataType, T.StringType) else F.upper(F.substring(text, -1, 1)).between("0", "9")
    df = df.withColumn("__text", F.when(text.isNull() | fine, F.lower(text)).otherwise(F.raise_error(F.concat(F.lit("not a number: "), text))))
    has_exponent, has_point = F.contains("__text", F.lit("e")), F.contains("__mantissa", F.lit("."))
    df = df.withColumns({"__mantissa": F.translate(F.substring_index("__text", "e", 1), "+-", ""),
                         "__exponent": F.when(has_exponent, F.substring_index("__text", "e", -1).cast("int"))})
    df = df.withColumn("__fraction", F.when(has_point, F.substring_index("__mantissa", ".", -1)).otherwise(""))
    return df.withColumns({"__digits": F.replace("__mantissa", F.lit("."), F.lit("")),
                           "__point": F.length(F.substring_index("__mantissa", ".", 1)) + F.coalesce("__exponent", F.lit(0))})


def _behind(df: DataFrame, col: str) -> Column:
    """Digits after the point: 1.0E-5 and 0.5 both as plain digits; trailing zeros of a number carry nothing, those of plain text do."""
    plain = F.greatest(F.length(F.rtrim("__digits", F.lit("0"))) - F.col("__point"), F.lit(0))
    if isinstance(df.schema[col].dataType, T.StringType):
        return F.when(F.col("__exponent").isNull(), F.length("__fraction")).otherwise(plain)
    return plain


def max_decimals(df: DataFrame, col: str = "prob") -> int:
    """Most digits after the point in any value."""
    return _parsed(df.select(col), col).agg(F.max(_behind(df, col))).first()[0] or 0


def to_fixed_point(df: DataFrame, col: str = "prob") -> tuple[DataFrame, int]:
    """Values times the smallest power of ten that makes all of them whole, and that power.

    The point moves within the digits of the value as text, so nothing is rounded or cut: 4.35 times 100 is 435. The result
    is BIGINT up to 18 digits, DECIMAL(38,0) up to 38, and text beyond, where Spark has no number for it.
    """
    require_columns(df, col)
    left = F.ltrim("__digits", F.lit("0"))
    ahead = F.when(left != "", F.col("__point") - F.length("__digits") + F.length(left))
    scale, ahead = _parsed(df.select(col), col).agg(F.max(_behind(df, col)), F.max(ahead)).first()
    scale, ahead = scale or 0, max(ahead or 0, 0)
    size = F.col("__point") + F.lit(scale)
    parsed = _parsed(df, col).withColumn("__digits", F.when(size > 0, F.rpad(F.substring("__digits", F.lit(1), size), size, "0"))
                                         .when(F.col("__text").isNotNull(), "0"))
    kind = "bigint" if ahead + scale <= 18 else "decimal(38,0)" if ahead + scale <= 38 else "string"
    shifted = F.col("__digits")
    if kind == "string":
        bare = F.ltrim("__digits", F.lit("0"))
        shifted = F.when(bare == "", "0").otherwise(bare)
    negative = F.startswith("__text", F.lit("-")) & (F.ltrim("__digits", F.lit("0")) != "")
    value = F.when(negative, F.concat(F.lit("-"), shifted)).otherwise(shifted).cast(kind)
    return parsed.withColumn(col, value).drop(*_PARSED), 10**scale


def text_to_long(spark: SparkSession, path: str, sep: str = "\t", on_mismatch: str = "truncate") -> DataFrame:
    """Fuzzy transaction text as ``(txn_id, item, prob DOUBLE)``."""
    lists = readers.read_fuzzy_text(spark, path, sep)
    return readers.fuzzy_long(lists, "double", on_mismatch).select("txn_id", "item", "prob")


def convert_text(spark: SparkSession, path: str, out: str, sep: str = "\t", compression: str = "zstd") -> None:
    writers.write_long_parquet(text_to_long(spark, path, sep), out, compression)


def transaction_lines(df: DataFrame, sep: str = "\t") -> DataFrame:
    """One ``items:values`` line per transaction, as ``(txn_id, value)``. Items keep their ``pos``
    order if there is one, else they are sorted. Without ``prob`` the line holds the items only."""
    order = "pos" if "pos" in df.columns else "item"
    fuzzy = "prob" in df.columns
    cell = F.struct(F.col(order).alias("o"), F.col("item").alias("i"),
                    *([F.col("prob").cast("string").alias("p")] if fuzzy else []))
    rows = df.groupBy("txn_id").agg(F.array_sort(F.collect_list(cell)).alias("t"))
    line = F.array_join(F.col("t.i"), sep)
    if fuzzy:
        line = F.concat(line, F.lit(":"), F.array_join(F.col("t.p"), sep))
    return rows.select("txn_id", line.alias("value"))


def write_transaction_text(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Transaction text in ``txn_id`` order."""
    transaction_lines(df, sep).orderBy("txn_id").select("value").write.text(path)


def replicate(df: DataFrame, times: int) -> DataFrame:
    """``times`` copies of all transactions under new ids; supports grow by the same factor."""
    if times < 1:
        raise ValueError("times must be at least 1")
    require_columns(df, "txn_id")
    if times == 1:
        return df
    span = df.agg(F.max("txn_id") - F.min("txn_id") + 1).first()[0] or 0
    copies = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return copies.withColumn("txn_id", F.col("txn_id") + F.col("_copy") * F.lit(span).cast("bigint")).drop("_copy")


def replicate_text(spark: SparkSession, path: str, times: int, out: str) -> None:
    """A text file with its lines ``times`` over, copy after copy."""
    from itemweave.plans.numbering import number_lines

    if times < 1:
        raise ValueError("times must be at least 1")
    lines = (spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")))
    numbered = number_lines(lines, "line")
    copies = numbered.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    copies.orderBy("copy", "line").select("value").write.text(out)
