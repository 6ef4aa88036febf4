"""Occurrences, item dictionary and encoding."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemweave.plans.numbering import number_rows


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def crisp_occurrences(df: DataFrame) -> DataFrame:
    """Distinct ``(txn_id, item)``: repeating an item in a transaction does not count twice."""
    require_columns(df, "txn_id", "item")
    return df.where(F.col("item").isNotNull() & F.col("txn_id").isNotNull()).select("txn_id", "item").distinct()


def fuzzy_occurrences(df: DataFrame, on_duplicate: str = "max", keep_absent: bool = False, parts: int | None = None,
                      group: Column | None = None) -> DataFrame:
    """One membership per ``(txn_id, item)``; memberships of 0 or less mean the item is absent.

    ``max`` keeps the largest of several memberships; ``last`` the one at the highest ``pos``.
    ``keep_absent`` leaves the absent ones in, for counting transactions. With ``parts`` rows are placed in so many partitions by
    ``txn_id``, or by ``group``, a function of it that becomes the column ``grp``; what follows by transaction needs no shuffle then.
    """
    require_columns(df, "txn_id", "item", "prob")
    if on_duplicate == "max":
        pick = F.max("prob")
    elif on_duplicate == "last":
        require_columns(df, "pos")
        pick = F.max_by("prob", "pos")
    else:
        raise ValueError(f"on_duplicate must be max or last, not {on_duplicate!r}")
    rows = df.where(F.col("item").isNotNull() & F.col("txn_id").isNotNull())
    kind = df.schema["prob"].dataType
    if isinstance(kind, T.FloatType):
        rows = rows.withColumn("prob", F.col("prob").cast("string").cast("double"))  # 0.7 stays 0.7
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        rows = rows.withColumn("prob", F.nanvl("prob", F.lit(0.0)))  # not a number: absent
    if on_duplicate == "max" and not keep_absent:
        rows = rows.where(F.col("prob") > 0)
    keys = ["txn_id", "item"]
    if group is not None:
        rows, keys = rows.withColumn("grp", group), ["grp", *keys]
    if parts:
        rows = rows.repartition(parts, keys[0])
    rows = rows.groupBy(*keys).agg(pick.alias("prob"))
    return rows if keep_absent else rows.where(F.col("prob") > 0)


def sum_type(kind: T.DataType) -> str:
    """The type of a sum of memberships: whole numbers and decimals stay exact."""
    if isinstance(kind, T.IntegralType):
        return "bigint"
    return f"decimal(38,{kind.scale})" if isinstance(kind, T.DecimalType) else "double"


def transaction_count(df: DataFrame) -> int:
    """Transactions that hold at least one item; the same for every engine."""
    if "item" in df.columns:
        df = df.where(F.col("item").isNotNull())
    return df.agg(F.count_distinct("txn_id")).first()[0]


def parse_threshold(value) -> tuple[float, bool]:
    """The number and whether it is a proportion: an int (or text without a point) is a count, a
    float (or text with a point) a proportion of the number of transactions."""
    if isinstance(value, str):
        value = float(value) if "." in value else int(value)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"not a threshold: {value!r}")
    return value, isinstance(value, float)


def share_of(proportion: float, n_transactions: int) -> int | float:
    """A proportion as a count, in decimal arithmetic: 0.07 of 100 is 7."""
    count = Decimal(str(proportion)) * n_transactions
    return int(count) if count == count.to_integral_value() else float(count)


def resolve_threshold(value, df: DataFrame, n_transactions: int | None = None):
    """The threshold as a count; see :func:`parse_threshold`."""
    number, proportion = parse_threshold(value)
    if not proportion:
        return number
    return share_of(number, n_transactions if n_transactions is not None else transaction_count(df))


def item_dictionary(df: DataFrame, min_support=1, min_frequency: int = 1, by: str = "freq") -> DataFrame:
    """Frequent items ``(item, rank, support, freq)``, ranked from 1 by descending frequency
    (``by="freq"``) or descending support (``by="support"``); ties go by item."""
    if by not in ("freq", "support"):
        raise ValueError("by must be freq or support")
    fuzzy = "prob" in df.columns
    occ = fuzzy_occurrences(df) if fuzzy else crisp_occurrences(df)
    support = F.sum("prob") if fuzzy else F.count(F.lit(1))
    items = (occ.groupBy("item").agg(support.alias("support"), F.count(F.lit(1)).alias("freq"))
             .where((F.col("support") >= resolve_threshold(min_support, df)) & (F.col("freq") >= min_frequency)))
    ranked = number_rows(items, [F.col(by).desc(), F.col("item")], "rank")
    return ranked.select("item", "rank", "support", "freq")


def encode(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Replace items by their rank; rows of items that are not in the dictionary go."""
    cols = ["txn_id", "rank"] + (["prob"] if "prob" in df.columns else [])
    return df.join(dictionary.select("item", "rank"), "item").select(*cols)
