"""Transactional inputs made from the given tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands per order; the membership is the discount in whole percent (some are 0)."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("txn_id"), F.col("p_brand").alias("item"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("prob"))


# One row per (txn_id, item); the crisp queries need the rows whose membership is 0 as well.
BASKET = """SELECT l_orderkey AS txn_id, p_brand AS item, max(CAST(round(l_discount * 100) AS BIGINT)) AS prob
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""


def userday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types per user and day; the membership is the largest value in hundredths."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") * 100 + F.datediff("ts", F.lit("2024-01-01"))).cast("bigint").alias("txn_id"),
        F.col("event_type").alias("item"), F.round(F.col("value") * 100).cast("bigint").alias("prob"))


USERDAY = """SELECT user_id * 100 + datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS txn_id,
event_type AS item, max(CAST(round(value * 100) AS BIGINT)) AS prob FROM events GROUP BY 1, 2"""


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types per hour, counted from 1."""
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    hour = F.floor((F.unix_timestamp("ts") - start) / 3600) + 1
    return table(spark, sf_dir, "events").select(hour.cast("bigint").alias("txn_id"), F.col("event_type").alias("item"))


HOURS = """SELECT DISTINCT datediff('hour', TIMESTAMP '2024-01-01', ts) + 1 AS txn_id, event_type AS item, 1 AS prob
FROM events"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-case words per document, whole texts."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("txn_id"), F.explode(F.split(F.lower("text"), "[ \\t\\n\\r]+")).alias("item")
    ).where(F.col("item") != "")


WORDS = """SELECT DISTINCT txn_id, item, 1 AS prob FROM (SELECT doc_id AS txn_id,
unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+')) AS item FROM documents) WHERE item <> ''"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents"


def sets_sql(source: str, max_len: int, support: str, frequency: str | None = None, crisp: bool = False,
             gap: int | None = None, periodic: int = 0, scale: int | None = None, prune: str | None = None) -> str:
    """Itemsets up to ``max_len`` by direct self-joins, one branch per length.

    ``support`` and ``frequency`` are SQL expressions for the thresholds; ``prune`` first drops items
    below the support, for inputs with long transactions.
    """
    value = "1" if crisp else "prob"
    head = f"WITH src AS ({source}), n AS (SELECT count(DISTINCT txn_id) AS n FROM src), "
    rows = f"SELECT txn_id, item, {value} AS m FROM src" + ("" if crisp else " WHERE prob > 0")
    if prune:
        rows += f" {'WHERE' if crisp else 'AND'} item IN (SELECT item FROM src GROUP BY 1 HAVING count(*) >= {prune})"
    head += f"o AS ({rows}) "
    branches = []
    for k in range(1, max_len + 1):
        names = " || ',' || ".join(f"a{i}.item" for i in range(1, k + 1))
        low = f"least({', '.join(f'a{i}.m' for i in range(1, k + 1))})" if k > 1 else "a1.m"
        joins = "o a1" + "".join(
            f" JOIN o a{i} ON a{i}.txn_id = a1.txn_id AND a{i}.item > a{i - 1}.item" for i in range(2, k + 1))
        occ = f"SELECT {names} AS items, a1.txn_id AS txn_id, {low} AS m FROM {joins}"
        if gap is not None:
            occ = (f"SELECT items, m, txn_id - lag(txn_id) OVER (PARTITION BY items ORDER BY txn_id) AS g FROM ({occ})")
        total = "CAST(sum(m) AS BIGINT)"
        shown = total if scale is None else f"CAST({total} AS DOUBLE) / {scale}"
        extra = f", CAST(count(CASE WHEN g <= {gap} THEN 1 END) AS BIGINT) AS periodic_freq" if gap is not None else ""
        having = f"sum(m) >= {support}"
        if frequency:
            having += f" AND count(*) >= {frequency}"
        if gap is not None:
            having += f" AND count(CASE WHEN g <= {gap} THEN 1 END) >= {periodic}"
        branches.append(f"SELECT items, {k} AS length, {shown} AS support, CAST(count(*) AS BIGINT) AS freq{extra} "
                        f"FROM ({occ}) GROUP BY items HAVING {having}")
    return head + " UNION ALL ".join(branches)
