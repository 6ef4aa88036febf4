"""Queries by name, with the SQL that must give the same table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import itemweave as iw
from itemweave.functions import columns, human_bytes, megabytes_per_second
from itemweave.operators import candidates as cand
from itemweave.operators import dictionary as dic
from itemweave.operators import experiments as exp
from itemweave.operators import layouts, prepare, textprofile
from itemweave.plans.numbering import number_rows
from itemweave.plans.storage import Workspace
from itemweave.sources import readers, writers
from workload.inputs import (
    BASKET,
    HOURS,
    LINES,
    USERDAY,
    WORDS,
    basket,
    hours,
    lines,
    sets_sql,
    table,
    userday,
    words,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def as_text(result: iw.MiningResult, *more: str) -> DataFrame:
    return result.itemsets.select(F.array_join("items", ",").alias("items"), "length", "support", "freq", *more)


# --- miners ------------------------------------------------------------------------------------

_CRISP = sets_sql(BASKET, 5, "0.004 * (SELECT n FROM n)", crisp=True)


@query("crisp_join", _CRISP)
def crisp_join(spark, d):
    return as_text(iw.frequent_itemsets(basket(spark, d), 0.004))


@query("crisp_bitset", _CRISP)
def crisp_bitset(spark, d):
    return as_text(iw.frequent_itemsets(basket(spark, d), 0.004, engine="bitset"))


@query("crisp_bitmap", _CRISP)
def crisp_bitmap(spark, d):
    return as_text(iw.frequent_itemsets(basket(spark, d), 0.004, engine="bitmap"))


@query("crisp_bitmap_sparse", _CRISP)
def crisp_bitmap_sparse(spark, d):
    """Ids with holes of a hundred thousand: the same sets."""
    sparse = basket(spark, d).withColumn("txn_id", F.col("txn_id") * 100_003)
    return as_text(iw.frequent_itemsets(sparse, 0.004, engine="bitmap"))


@query("crisp_fpgrowth", _CRISP)
def crisp_fpgrowth(spark, d):
    return as_text(iw.frequent_itemsets(basket(spark, d), 0.004, engine="fpgrowth"))


@query("crisp_grouped", _CRISP)
def crisp_grouped(spark, d):
    return as_text(iw.frequent_itemsets(basket(spark, d), 0.004, engine="grouped"))


def _stored(spark, d) -> DataFrame:
    ws = Workspace(spark)
    name = "transactions_" + uuid.uuid4().hex
    writers.write_stored(basket(spark, d), name, ws.path("stored"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.table(name)


@query("crisp_stored", _CRISP)
def crisp_stored(spark, d):
    return as_text(iw.frequent_itemsets(_stored(spark, d), 0.004, engine="stored"))


@query("crisp_userday", sets_sql(USERDAY, 5, "0.005 * (SELECT n FROM n)", crisp=True))
def crisp_userday(spark, d):
    return as_text(iw.frequent_itemsets(userday(spark, d), 0.005))


@query("crisp_words", sets_sql(WORDS, 6, "0.45 * (SELECT n FROM n)", crisp=True, prune="0.45 * (SELECT n FROM n)"))
def crisp_words(spark, d):
    return as_text(iw.frequent_itemsets(words(spark, d), 0.45))


@query("crisp_words_bitset", sets_sql(WORDS, 8, "0.4 * (SELECT n FROM n)", crisp=True, prune="0.4 * (SELECT n FROM n)"))
def crisp_words_bitset(spark, d):
    return as_text(iw.frequent_itemsets(words(spark, d), 0.4, engine="bitset"))


@query("crisp_words_pairs", sets_sql(WORDS, 7, "0.42 * (SELECT n FROM n)", crisp=True, prune="0.42 * (SELECT n FROM n)"))
def crisp_words_pairs(spark, d):
    """Which words go together, in sets of any length."""
    return as_text(iw.frequent_itemsets(words(spark, d), 0.42))


_STEPS = """SELECT DISTINCT o_orderkey % 100 AS txn_id, r_name AS item, 1 AS prob FROM orders
JOIN region ON o_orderkey % 100 < r_regionkey + 5"""
_ALL_STEPS = "SELECT DISTINCT o_orderkey % 100 AS txn_id, 'all' AS item, 1 AS prob FROM orders"


@query("crisp_boundary", sets_sql(f"{_STEPS} UNION ALL {_ALL_STEPS}", 4, "0.07 * (SELECT n FROM n)", crisp=True))
def crisp_boundary(spark, d):
    """100 transactions; one item is in exactly 7 of them, and the threshold is 0.07."""
    txns = table(spark, d, "orders").select((F.col("o_orderkey") % 100).alias("txn_id")).distinct()
    steps = txns.join(F.broadcast(table(spark, d, "region")), F.col("txn_id") < F.col("r_regionkey") + 5)
    rows = steps.select("txn_id", F.col("r_name").alias("item")).union(txns.select("txn_id", F.lit("all")))
    return as_text(iw.frequent_itemsets(rows, 0.07))


_KNOWN = USERDAY.replace("FROM events", "FROM events WHERE event_type <> 'error'")


@query("crisp_null_items", f"""SELECT e.engine, s.* FROM ({sets_sql(_KNOWN, 4, "0.1 * (SELECT n FROM n)", crisp=True)}) s
CROSS JOIN (VALUES ('join'), ('bitset'), ('bitmap'), ('fpgrowth'), ('grouped')) e(engine)""")
def crisp_null_items(spark, d):
    """Transactions with nothing but NULL items do not count, whatever the engine."""
    rows = userday(spark, d).withColumn("item", F.nullif("item", F.lit("error")))
    found = [as_text(iw.frequent_itemsets(rows, 0.1, engine=e)).withColumn("engine", F.lit(e))
             for e in ("join", "bitset", "bitmap", "fpgrowth", "grouped")]
    return exp.union_metrics(found)


_FUZZY = sets_sql(BASKET, 5, "0.01 * (SELECT n FROM n)")


@query("fuzzy_fixed", _FUZZY)
def fuzzy_fixed(spark, d):
    return as_text(iw.fuzzy_frequent_itemsets(basket(spark, d), 0.01))


@query("fuzzy_grouped", _FUZZY)
def fuzzy_grouped(spark, d):
    return as_text(iw.fuzzy_frequent_itemsets(basket(spark, d), 0.01, engine="grouped"))


@query("fuzzy_stored", _FUZZY)
def fuzzy_stored(spark, d):
    return as_text(iw.fuzzy_frequent_itemsets(_stored(spark, d), 0.01, engine="stored"))


@query("fuzzy_dual", sets_sql(BASKET, 5, "0.01 * (SELECT n FROM n)", frequency="50"))
def fuzzy_dual(spark, d):
    return as_text(iw.fuzzy_frequent_itemsets(basket(spark, d), 0.01, min_frequency=50))


@query("fuzzy_scaled", sets_sql(USERDAY, 5, "50 * (SELECT n FROM n)", scale=100))
def fuzzy_scaled(spark, d):
    return as_text(iw.fuzzy_frequent_itemsets(userday(spark, d), 50.0, scaling_factor=100))


@query("fuzzy_floating", "SELECT items, length, round(support, 4) AS support, freq FROM ("
       + sets_sql(USERDAY, 5, "50 * (SELECT n FROM n)", scale=100) + ")")
def fuzzy_floating(spark, d):
    df = userday(spark, d).withColumn("prob", F.col("prob") / 100)
    found = as_text(iw.fuzzy_frequent_itemsets(df, 0.5))
    return found.withColumn("support", F.round("support", 4))


def _in_hundredths(kind: str):
    def run(spark, d):
        df = userday(spark, d).withColumn("prob", (F.col("prob") / 100).cast(kind))
        found = as_text(iw.fuzzy_frequent_itemsets(df, 0.5))
        return found.withColumn("support", F.round(F.col("support").cast("double"), 4))
    return run


for _name, _kind in (("fuzzy_decimal", "decimal(9,2)"), ("fuzzy_float", "float")):
    query(_name, ORACLES["fuzzy_floating"])(_in_hundredths(_kind))


_LAST = """SELECT l_orderkey AS txn_id, p_brand AS item, arg_max(CAST(round(l_discount * 100) AS BIGINT),
l_linenumber * 100 + CAST(round(l_discount * 100) AS BIGINT)) AS prob
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""


@query("fuzzy_last_duplicate", sets_sql(_LAST, 5, "0.01 * (SELECT n FROM n)"))
def fuzzy_last_duplicate(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    df = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("txn_id"), F.col("p_brand").alias("item"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("prob"),
        (F.col("l_linenumber") * 100 + F.round(F.col("l_discount") * 100).cast("bigint")).alias("pos"))
    return as_text(iw.fuzzy_frequent_itemsets(df, 0.01, on_duplicate="last"))


@query("periodic_hours", sets_sql(HOURS, 5, "1", gap=2, periodic=100))
def periodic_hours(spark, d):
    return as_text(iw.fuzzy_periodic_frequent_itemsets(hours(spark, d), 1, 100, 2), "periodic_freq")


@query("periodic_centred", sets_sql(f"SELECT txn_id - 361 AS txn_id, item, 100 AS prob FROM ({HOURS})", 5, "1", gap=2, periodic=100))
def periodic_centred(spark, d):
    """Ids on both sides of 0, and memberships of one byte."""
    df = hours(spark, d).select((F.col("txn_id") - 361).alias("txn_id"), "item", F.lit(100).cast("tinyint").alias("prob"))
    return as_text(iw.fuzzy_periodic_frequent_itemsets(df, 1, 100, 2), "periodic_freq")


@query("periodic_fuzzy_basket", sets_sql(BASKET, 3, "0.01 * (SELECT n FROM n)", gap=40, periodic=150))
def periodic_fuzzy_basket(spark, d):
    return as_text(iw.fuzzy_periodic_frequent_itemsets(basket(spark, d), 0.01, 150, 40), "periodic_freq")


@query("replicated_mining", "SELECT items, length, support * 3 AS support, freq * 3 AS freq FROM (" + _FUZZY + ")")
def replicated_mining(spark, d):
    return as_text(iw.fuzzy_frequent_itemsets(prepare.replicate(basket(spark, d), 3), 0.01))


# --- dictionary, candidates, counting ----------------------------------------------------------

_ITEMS = f"""WITH o AS ({BASKET}), i AS (SELECT item, CAST(sum(prob) AS BIGINT) AS support,
CAST(count(*) AS BIGINT) AS freq FROM o WHERE prob > 0 GROUP BY 1 HAVING sum(prob) >= 1000)"""


@query("item_dictionary", _ITEMS + """ SELECT item, CAST(row_number() OVER (ORDER BY freq DESC, item) AS BIGINT)
AS rank, support, freq FROM i""")
def item_dictionary(spark, d):
    return dic.item_dictionary(basket(spark, d), 1000)


@query("item_dictionary_by_support", _ITEMS + """ SELECT item, CAST(row_number() OVER (ORDER BY support DESC, item) AS BIGINT)
AS rank, support, freq FROM i""")
def item_dictionary_by_support(spark, d):
    return dic.item_dictionary(basket(spark, d), 1000, by="support")


@query("encode", _ITEMS + """ SELECT o.txn_id, r.rank, o.prob FROM o JOIN (SELECT item,
CAST(row_number() OVER (ORDER BY freq DESC, item) AS BIGINT) AS rank FROM i) r ON o.item = r.item WHERE o.prob > 0""")
def encode(spark, d):
    df = basket(spark, d)
    return dic.encode(dic.fuzzy_occurrences(df), dic.item_dictionary(df, 1000))


_PAIRS = f"""WITH o AS ({BASKET}), n AS (SELECT count(DISTINCT txn_id) AS n FROM o), p AS (SELECT a.item AS x, b.item AS y
FROM o a JOIN o b ON a.txn_id = b.txn_id AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 0.022 * (SELECT n FROM n)) """


@query("candidates", _PAIRS + "SELECT p.x || ',' || p.y || ',' || q.y AS items FROM p JOIN p q ON p.x = q.x AND p.y < q.y")
def candidates(spark, d):
    found = iw.frequent_itemsets(basket(spark, d), 0.022, max_len=2).itemsets.where("length = 2")
    return cand.candidates(found).select(F.array_join("items", ",").alias("items"))


@query("candidates_pruned", _PAIRS + """SELECT p.x || ',' || p.y || ',' || q.y AS items FROM p
JOIN p q ON p.x = q.x AND p.y < q.y JOIN p r ON r.x = p.y AND r.y = q.y""")
def candidates_pruned(spark, d):
    found = iw.frequent_itemsets(basket(spark, d), 0.022, max_len=2).itemsets.where("length = 2")
    return cand.candidates(found, found).select(F.array_join("items", ",").alias("items"))


def _asked_sets(spark, d) -> DataFrame:
    """Brands of neighbouring parts: pairs and triples that may or may not be bought together."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("b1"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("b1").alias("b2"))
    r = p.select((F.col("p_partkey") - 2).alias("p_partkey"), F.col("b1").alias("b3"))
    return p.join(q, "p_partkey").join(r, "p_partkey").select(
        F.explode(F.array(F.array("b1"), F.array("b1", "b2"), F.array("b1", "b2", "b3"))).alias("items"))


def _count_sql(value: str, where: str) -> str:
    return f"""WITH o AS (SELECT txn_id, item, {value} AS m FROM ({BASKET}) {where}),
t AS (SELECT p.p_brand AS b1, q.p_brand AS b2, r.p_brand AS b3 FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1
JOIN part r ON r.p_partkey = p.p_partkey + 2),
s AS (SELECT DISTINCT list_sort(list_distinct(l)) AS items FROM (SELECT [b1] AS l FROM t UNION ALL SELECT [b1, b2] FROM t
UNION ALL SELECT [b1, b2, b3] FROM t)),
h AS (SELECT s.items, o.txn_id, min(o.m) AS m FROM (SELECT items, unnest(items) AS item FROM s) s
JOIN o ON o.item = s.item GROUP BY 1, 2 HAVING count(*) = len(s.items))
SELECT array_to_string(s.items, ',') AS items, CAST(len(s.items) AS INTEGER) AS length,
CAST(coalesce(sum(h.m), 0) AS BIGINT) AS support, CAST(count(h.txn_id) AS BIGINT) AS freq
FROM s LEFT JOIN h ON h.items = s.items GROUP BY s.items"""


@query("count_support_crisp", _count_sql("1", ""))
def count_support_crisp(spark, d):
    counted = cand.count_support(basket(spark, d), _asked_sets(spark, d))
    return counted.select(F.array_join("items", ",").alias("items"), "length", "support", "freq")


@query("count_support_fuzzy", _count_sql("prob", "WHERE prob > 0"))
def count_support_fuzzy(spark, d):
    counted = cand.count_support(basket(spark, d), _asked_sets(spark, d), fuzzy=True)
    return counted.select(F.array_join("items", ",").alias("items"), "length", "support", "freq")


@query("level_statistics", f"""SELECT length AS k, CAST(count(*) AS BIGINT) AS frequent,
CAST(sum(freq) AS BIGINT) AS occurrences FROM ({sets_sql(USERDAY, 5, "1", crisp=True)}) GROUP BY 1""")
def level_statistics(spark, d):
    return iw.frequent_itemsets(userday(spark, d), 1).levels.select("k", "frequent", "occurrences")


# --- sources -----------------------------------------------------------------------------------

_NUMBERED = f"SELECT CAST(dense_rank() OVER (ORDER BY txn_id) AS BIGINT) AS txn_id, item, prob FROM ({BASKET})"


@query("read_crisp_text", f"SELECT txn_id, item FROM ({_NUMBERED})")
def read_crisp_text(spark, d):
    path = Workspace(spark).path("basket.txt")
    prepare.write_transaction_text(dic.crisp_occurrences(basket(spark, d)), path)
    return readers.load_transactions(spark, path)


_FUZZY_NUMBERED = f"""SELECT CAST(dense_rank() OVER (ORDER BY txn_id) AS BIGINT) AS txn_id, item, prob
FROM ({BASKET}) WHERE prob > 0"""


@query("read_fuzzy_text", _FUZZY_NUMBERED)
def read_fuzzy_text(spark, d):
    path = Workspace(spark).path("basket.txt")
    prepare.write_transaction_text(dic.fuzzy_occurrences(basket(spark, d)), path, sep="|")
    return readers.load_transactions(spark, path, fuzzy=True, sep="|").select("txn_id", "item", "prob")


@query("text_to_long", f"SELECT txn_id, item, CAST(prob AS DOUBLE) / 4 AS prob FROM ({_FUZZY_NUMBERED})")
def text_to_long(spark, d):
    ws = Workspace(spark)
    df = dic.fuzzy_occurrences(basket(spark, d)).withColumn("prob", F.col("prob") / 4)
    prepare.write_transaction_text(df, ws.path("floating.txt"))
    prepare.convert_text(spark, ws.path("floating.txt"), ws.path("floating.parquet"))
    return readers.load_transactions(spark, ws.path("floating.parquet"), fuzzy=True)


@query("aligned_explode_truncate", f"""SELECT txn_id, CAST(pos - 1 AS INTEGER) AS pos, items[pos] AS item, vals[pos] AS prob FROM (
SELECT txn_id, items, vals, unnest(range(1, least(len(items), coalesce(len(vals), 0)) + 1)) AS pos FROM (
SELECT txn_id, list(item ORDER BY item) AS items, list(prob ORDER BY item) FILTER (WHERE prob > 0) AS vals
FROM ({BASKET}) GROUP BY txn_id))""")
def aligned_explode_truncate(spark, d):
    pairs = basket(spark, d).groupBy("txn_id", "item").agg(F.max("prob").alias("prob"))
    lists = pairs.groupBy("txn_id").agg(F.array_sort(F.collect_list(F.struct("item", "prob"))).alias("t")).select(
        "txn_id", F.col("t.item").alias("items"),
        F.filter("t.prob", lambda x: x > 0).cast("array<string>").alias("values"))
    return readers.fuzzy_long(lists)


@query("read_crisp_parquet", f"SELECT txn_id, item FROM ({BASKET})")
def read_crisp_parquet(spark, d):
    path = Workspace(spark).path("crisp.parquet")
    writers.write_long_parquet(dic.crisp_occurrences(basket(spark, d)), path)
    return readers.load_transactions(spark, path)


@query("read_fuzzy_parquet", f"SELECT txn_id, item, prob FROM ({BASKET}) WHERE prob > 0")
def read_fuzzy_parquet(spark, d):
    path = Workspace(spark).path("fixed.parquet")
    writers.write_long_parquet(dic.fuzzy_occurrences(basket(spark, d)), path, "snappy")
    return readers.load_transactions(spark, path, fuzzy=True)


@query("read_index_parquet", f"""SELECT txn_id - (SELECT min(l_orderkey) FROM lineitem) + 1 AS txn_id, item,
CAST(prob AS DOUBLE) / 4 AS prob FROM ({BASKET})""")
def read_index_parquet(spark, d):
    path = Workspace(spark).path("indexed.parquet")
    df = basket(spark, d).groupBy("txn_id", "item").agg((F.max("prob") / 4).alias("prob"))
    low = df.agg(F.min("txn_id")).first()[0]
    df.select("item", "prob", (F.col("txn_id") - low).alias("__index_level_0__")).write.parquet(path)
    return readers.load_transactions(spark, path, fuzzy=True)


@query("frame_input", sets_sql(USERDAY, 5, "50 * (SELECT n FROM n)"))
def frame_input(spark, d):
    rows = dic.fuzzy_occurrences(userday(spark, d)).groupBy("txn_id").agg(
        F.collect_list("item").alias("Transactions"), F.collect_list("prob").alias("fuzzyValues"))
    return as_text(iw.fuzzy_frequent_itemsets(readers.from_lists(rows), 50.0))


_ORDER_LINES = """SELECT l_orderkey AS row_index, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS vals
FROM lineitem GROUP BY 1"""


def _order_rows(spark, d) -> DataFrame:
    """Part numbers per order as ragged rows."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row_index")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))),
        lambda x: x["l_partkey"]).alias("values"))


@query("read_wide_csv", f"""SELECT CAST(row_number() OVER (ORDER BY row_index) - 1 AS BIGINT) AS line_id, vals[1] AS c0,
vals[3] AS c2 FROM ({_ORDER_LINES})""")
def read_wide_csv(spark, d):
    path = Workspace(spark).path("wide.csv")
    writers.write_ragged_csv(_order_rows(spark, d).orderBy("row_index"), path)
    return readers.read_wide(spark, path, dtype="bigint", usecols=[0, 2], line_ids=True).select("line_id", "c0", "c2")


@query("codec_matrix", """SELECT f.format, f.codec, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_partkey) AS BIGINT) AS total
FROM lineitem CROSS JOIN (VALUES ('csv', 'none'), ('csv', 'gzip'), ('parquet', 'none'), ('parquet', 'snappy'),
('parquet', 'zstd'), ('parquet', 'lz4')) f(format, codec) GROUP BY 1, 2""")
def codec_matrix(spark, d):
    ws = Workspace(spark)
    rows = _order_rows(spark, d).persist()
    out = []
    for codec in ("none", "gzip"):
        writers.write_ragged_csv(rows, ws.path(f"{codec}.csv"), compression=codec)
        read = textprofile.parse_ints(spark.read.text(ws.path(f"{codec}.csv")))
        out.append(read.select(F.lit("csv").alias("format"), F.lit(codec).alias("codec"), "value"))
    for codec in ("none", "snappy", "zstd", "lz4"):
        writers.write_long_values(rows, ws.path(f"{codec}.parquet"), codec)
        read = spark.read.parquet(ws.path(f"{codec}.parquet"))
        out.append(read.select(F.lit("parquet").alias("format"), F.lit(codec).alias("codec"), "value"))
    rows.unpersist()
    return exp.union_metrics(out).groupBy("format", "codec").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


# --- sinks -------------------------------------------------------------------------------------

def _saved(spark, d, style: str) -> DataFrame:
    path = Workspace(spark).path("patterns.txt")
    iw.fuzzy_frequent_itemsets(userday(spark, d), 50.0).save(path, style)
    return spark.read.text(path)


_USERDAY_SETS = sets_sql(USERDAY, 5, "50 * (SELECT n FROM n)")


@query("save_comma", f"SELECT items || chr(9) || support AS value FROM ({_USERDAY_SETS})")
def save_comma(spark, d):
    return _saved(spark, d, "comma")


@query("save_tab", f"SELECT replace(items, ',', chr(9)) || ':' || support AS value FROM ({_USERDAY_SETS})")
def save_tab(spark, d):
    return _saved(spark, d, "tab")


@query("save_sorted", f"""SELECT CAST(row_number() OVER (ORDER BY length, items) - 1 AS BIGINT) AS line,
replace(items, ',', chr(9)) || ':' || support AS value FROM ({_USERDAY_SETS})""")
def save_sorted(spark, d):
    path = Workspace(spark).path("patterns.txt")
    iw.fuzzy_frequent_itemsets(userday(spark, d), 50.0).save(path, "sorted")
    lines_ = readers.read_lines(spark, path)
    from itemweave.plans.numbering import number_lines
    return number_lines(lines_, "line", first=0)


@query("save_by_text", f"""SELECT CAST(row_number() OVER (ORDER BY length(items), items) - 1 AS BIGINT) AS line,
replace(items, ',', chr(9)) || ':' || support AS value FROM ({_USERDAY_SETS})""")
def save_by_text(spark, d):
    path = Workspace(spark).path("patterns.txt")
    iw.fuzzy_frequent_itemsets(userday(spark, d), 50.0).save(path, "by_text")
    from itemweave.plans.numbering import number_lines
    return number_lines(readers.read_lines(spark, path), "line", first=0)


@query("patterns_frame", f"""SELECT replace(items, ',', ' ') AS "Patterns", support AS "Support" FROM ({_USERDAY_SETS})""")
def patterns_frame(spark, d):
    return iw.fuzzy_frequent_itemsets(userday(spark, d), 50.0).to_frame(" ")


@query("wide_parquet", f"""SELECT CAST(i - 1 AS INTEGER) AS col, vals[i] AS value FROM (
SELECT vals, unnest(range(1, len(vals) + 1)) AS i FROM ({_ORDER_LINES}))""")
def wide_parquet(spark, d):
    """Every cell of the wide table with its column, however many columns the longest order needs."""
    path = Workspace(spark).path("wide.parquet")
    writers.write_wide_parquet(_order_rows(spark, d), path, compression="zstd")
    wide = spark.read.parquet(path)
    cells = F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).alias("value")) for i, c in enumerate(wide.columns)])
    return wide.select(F.explode(cells).alias("c")).select("c.col", "c.value").where("value IS NOT NULL")


@query("long_values", f"SELECT row_index, unnest(vals) AS value FROM ({_ORDER_LINES})")
def long_values(spark, d):
    path = Workspace(spark).path("long.parquet")
    writers.write_long_values(_order_rows(spark, d), path, "snappy")
    return spark.read.parquet(path)


@query("ragged_csv", f"SELECT array_to_string(vals, ',') AS value FROM ({_ORDER_LINES})")
def ragged_csv(spark, d):
    path = Workspace(spark).path("ragged.csv")
    writers.write_ragged_csv(_order_rows(spark, d), path, compression="gzip")
    return spark.read.text(path)


# --- preparation and layouts -------------------------------------------------------------------

@query("fixed_point", """SELECT l_orderkey AS txn_id, p_brand AS item, CAST(round(l_discount * 100) AS BIGINT) AS prob,
100 AS scale FROM lineitem JOIN part ON l_partkey = p_partkey""")
def fixed_point(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    df = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("txn_id"), F.col("p_brand").alias("item"), F.col("l_discount").cast("string").alias("prob"))
    scaled, scale = prepare.to_fixed_point(df)
    return scaled.withColumn("scale", F.lit(scale))


@query("transaction_text", f"""SELECT string_agg(item, chr(9) ORDER BY item) || ':' || string_agg(CAST(prob AS VARCHAR),
chr(9) ORDER BY item) AS value FROM ({BASKET}) WHERE prob > 0 GROUP BY txn_id""")
def transaction_text(spark, d):
    path = Workspace(spark).path("fixed.txt")
    prepare.write_transaction_text(dic.fuzzy_occurrences(basket(spark, d)), path)
    return spark.read.text(path)


@query("replicate", f"""WITH b AS (SELECT * FROM ({BASKET}) WHERE prob > 0) SELECT txn_id + c * (SELECT max(txn_id) - min(txn_id) + 1 FROM b) AS txn_id, item, prob FROM b
CROSS JOIN (VALUES (0), (1), (2)) v(c)""")
def replicate(spark, d):
    return prepare.replicate(dic.fuzzy_occurrences(basket(spark, d)), 3)


_WIDE = """SELECT o_orderkey AS line_id, nullif(o_orderstatus, 'F') AS c0, o_orderpriority AS c1,
CASE WHEN o_orderstatus = 'O' THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS c2 FROM orders"""


def _wide(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("line_id"), F.nullif("o_orderstatus", F.lit("F")).alias("c0"),
        F.col("o_orderpriority").alias("c1"),
        F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_custkey").cast("string")).alias("c2"))


_SPARSE3 = f"""SELECT line_id, 0 AS col, c0 AS item FROM ({_WIDE}) WHERE c0 <> '' UNION ALL
SELECT line_id, 1, c1 FROM ({_WIDE}) WHERE c1 <> '' UNION ALL SELECT line_id, 2, c2 FROM ({_WIDE}) WHERE c2 <> ''"""


@query("dense_parquet", _WIDE)
def dense_parquet(spark, d):
    path = Workspace(spark).path("dense.parquet")
    layouts.to_dense(_wide(spark, d), path)
    return spark.read.parquet(path)


@query("wide_csv", f"""SELECT coalesce(c0, '') || ',' || c1 || CASE WHEN c2 <> '' THEN ',' || c2 ELSE '' END AS value FROM ({_WIDE})""")
def wide_csv(spark, d):
    """Sparse back to wide, and on to lines of text."""
    path = Workspace(spark).path("wide.csv")
    writers.write_wide_csv(layouts.from_sparse3(layouts.to_sparse3(_wide(spark, d)), 3).drop("line_id"), path)
    return spark.read.text(path)


@query("read_headered", "SELECT o_orderpriority, CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders")
def read_headered(spark, d):
    path = Workspace(spark).path("orders.csv")
    table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").write.option("header", True).csv(path)
    return readers.read_headered(spark, path, ["o_orderpriority", "o_orderkey"])


@query("sparse3", _SPARSE3)
def sparse3(spark, d):
    return layouts.to_sparse3(_wide(spark, d))


@query("sparse2", f"SELECT line_id, item FROM ({_SPARSE3})")
def sparse2(spark, d):
    return layouts.to_sparse2(_wide(spark, d))


@query("from_sparse3", f"SELECT line_id, c0, c1, nullif(c2, '') AS c2 FROM ({_WIDE})")
def from_sparse3(spark, d):
    return layouts.from_sparse3(layouts.to_sparse3(_wide(spark, d)), 3)


@query("from_sparse2", f"""SELECT line_id, l[1] AS c0, l[2] AS c1, l[3] AS c2 FROM (SELECT line_id, list(item ORDER BY col) AS l
FROM ({_SPARSE3}) GROUP BY 1)""")
def from_sparse2(spark, d):
    return layouts.from_sparse2(layouts.to_sparse3(_wide(spark, d)), order="col")


@query("preview_rows", """SELECT doc_id, line FROM (SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS BIGINT) AS line
FROM documents) WHERE line <= 5""")
def preview_rows(spark, d):
    """The first five by number."""
    df = table(spark, d, "documents")
    return textprofile.preview(number_rows(df, [F.col("n_chars").desc(), F.col("doc_id")], "line").select("doc_id", "line"), 5)


@query("largest_rows", """SELECT doc_id, n_chars FROM documents
WHERE n_chars IN (SELECT DISTINCT n_chars FROM documents ORDER BY n_chars DESC LIMIT 10)""")
def largest_rows_query(spark, d):
    return exp.largest_rows(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 10)


@query("power_of_two", "SELECT doc_id, CASE WHEN n_chars >= 1 THEN CAST(pow(2, ceil(log2(n_chars))) AS BIGINT) END AS room FROM documents")
def power_of_two(spark, d):
    return table(spark, d, "documents").select("doc_id", columns.next_power_of_two(F.col("n_chars")).alias("room"))


@query("number_rows", f"""SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS BIGINT) AS position
FROM documents""")
def number_rows_query(spark, d):
    df = table(spark, d, "documents").select("doc_id", "n_chars")
    return number_rows(df, [F.col("n_chars").desc(), F.col("doc_id")], "position").select("doc_id", "position")


@query("profile_delimited", f"""SELECT CAST(count(*) AS BIGINT) AS lines, CAST(sum(len(f)) AS BIGINT) AS total_items,
CAST(min(len(f)) AS BIGINT) AS min_items, CAST(max(len(f)) AS BIGINT) AS max_items,
CAST(sum(len(list_filter(f, lambda x: regexp_matches(x, '[0-9]')))) AS BIGINT) AS numeric_tokens
FROM (SELECT string_split(value, ' ') AS f FROM ({LINES}))""")
def profile_delimited(spark, d):
    return textprofile.profile_delimited(lines(spark, d), " ")


@query("items_per_line", f"""SELECT CAST(len(string_split(value, ' ')) AS BIGINT) AS items, CAST(count(*) AS BIGINT) AS lines
FROM ({LINES}) GROUP BY 1""")
def items_per_line(spark, d):
    return textprofile.items_per_line(lines(spark, d), " ")


@query("parse_ints", f"""SELECT doc_id, CASE WHEN x = '' THEN 0 ELSE TRY_CAST(x AS BIGINT) END AS value FROM (
SELECT doc_id, regexp_extract(f, '^ *([-+]?[0-9]+)', 1) AS x FROM (
SELECT doc_id, unnest(string_split(value, ',')) AS f FROM ({LINES})) WHERE f <> '')""")
def parse_ints(spark, d):
    return textprofile.parse_ints(lines(spark, d), ",")


@query("human_bytes", """SELECT doc_id, printf('%.1f', n_chars / CASE WHEN n_chars < 1024 THEN 1.0 WHEN n_chars < 1048576
THEN 1024.0 ELSE 1048576.0 END) || CASE WHEN n_chars < 1024 THEN 'B' WHEN n_chars < 1048576 THEN 'KiB' ELSE 'MiB' END AS shown,
round(CAST(n_chars AS DOUBLE) / 1048576.0 / 0.5, 9) AS mb_per_s FROM documents""")
def human_bytes_query(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", human_bytes(F.col("n_chars")).alias("shown"),
        F.round(megabytes_per_second(F.col("n_chars"), F.lit(0.5)), 9).alias("mb_per_s"))


# --- experiment tables -------------------------------------------------------------------------

_CENTS = "CAST(round(value * 100) AS BIGINT)"


def _cents(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        "event_type", "user_id", F.to_date("ts").alias("day"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))


@query("run_log_metrics", f"""SELECT event_type, CAST(user_id AS BIGINT) AS user_id, CAST(sum({_CENTS}) AS DOUBLE) AS exec_time,
CAST(max({_CENTS}) AS DOUBLE) AS cpu_mem_mb, CASE WHEN count(*) > 1 THEN CAST(min({_CENTS}) AS DOUBLE) END AS gpu_mem_mb,
CAST(count(*) AS DOUBLE) AS patterns_found FROM events GROUP BY 1, 2""")
def run_log_metrics(spark, d):
    g = _cents(spark, d).groupBy("event_type", "user_id").agg(
        F.sum("cents").alias("s"), F.max("cents").alias("hi"), F.min("cents").alias("lo"), F.count("*").alias("n"))
    # The lines a run prints.
    text = F.concat(
        F.lit("--- Miner Results ---\nExecution Time: "), F.col("s").cast("string"), F.lit(" seconds\nPeak CPU Memory Usage: "),
        F.col("hi").cast("string"), F.lit(" MB\n"),
        F.when(F.col("n") > 1, F.concat(F.lit("Peak GPU (driver) Used: "), F.col("lo").cast("string"), F.lit(" MB\n"))).otherwise(""),
        F.lit("Patterns Found: "), F.col("n").cast("string"), F.lit("\n---"))
    return exp.extract_metrics(g.select("event_type", "user_id", text.alias("text")))


@query("read_run_logs", f"""SELECT event_type, CAST(sum({_CENTS}) AS DOUBLE) AS exec_time, CAST(NULL AS DOUBLE) AS gpu_mem_mb,
CAST(count(*) AS DOUBLE) AS patterns_found FROM events GROUP BY 1""")
def read_run_logs(spark, d):
    """Log files, one for each event type."""
    path = Workspace(spark).path("logs")
    g = _cents(spark, d).groupBy("event_type").agg(F.sum("cents").alias("s"), F.count("*").alias("n"))
    text = F.concat(F.lit("start\nexecution time: "), F.col("s").cast("string"), F.lit(" seconds\nTotal Patterns Found: "), F.col("n").cast("string"))
    g.select("event_type", text.alias("value")).write.partitionBy("event_type").text(path)
    found = exp.extract_metrics(exp.read_logs(spark, path + "/*"))
    return found.select(F.regexp_extract("path", "event_type=([^/]*)", 1).alias("event_type"), "exec_time", "gpu_mem_mb", "patterns_found")


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("comparison_table", f"""SELECT support_quant_int,
{", ".join(f"max(CASE WHEN event_type = '{e}' THEN {k[0]} END) AS {k}_{e}" for k in ("time", "patterns") for e in _TYPES)}
FROM (SELECT user_id AS support_quant_int, event_type, CAST(sum({_CENTS}) AS DOUBLE) AS t, CAST(count(*) AS BIGINT) AS p
FROM events GROUP BY 1, 2) GROUP BY 1""")
def comparison_table(spark, d):
    metrics = _cents(spark, d).groupBy(F.col("user_id").alias("support_quant_int"), F.col("event_type").alias("algorithm")).agg(
        F.sum("cents").cast("double").alias("exec_time"), F.count("*").alias("patterns_found"))
    return exp.comparison_table(metrics, _TYPES)


@query("metrics_csv", f"""SELECT CAST(user_id AS BIGINT) AS support_quant_int, event_type AS algorithm,
CAST(sum({_CENTS}) AS DOUBLE) AS exec_time, CAST(count(*) AS BIGINT) AS patterns_found FROM events GROUP BY 1, 2""")
def metrics_csv(spark, d):
    path = Workspace(spark).path("metrics.csv")
    metrics = _cents(spark, d).groupBy(F.col("user_id").alias("support_quant_int"), F.col("event_type").alias("algorithm")).agg(
        F.sum("cents").cast("double").alias("exec_time"), F.count("*").alias("patterns_found"))
    writers.write_metrics(metrics, path)
    return spark.read.csv(path, header=True, schema=metrics.schema)


@query("timing_summary", f"""SELECT event_type, CAST(user_id AS BIGINT) AS user_id, CAST(count(*) AS BIGINT) AS runs,
CASE WHEN count(*) >= 3 THEN CAST(sum(c) - min(c) - max(c) AS DOUBLE) / (count(*) - 2) ELSE avg(c) END AS mean_seconds
FROM (SELECT event_type, user_id, {_CENTS} AS c FROM events) GROUP BY 1, 2""")
def timing_summary(spark, d):
    return exp.timing_summary(_cents(spark, d), ["event_type", "user_id"], "cents")


_SWEEP = [0.004, 0.006, 0.02, 0.05]


@query("threshold_sweep", f"""WITH r AS ({_CRISP}), v(f) AS (VALUES
(0.004), (0.006), (0.02), (0.05)), t AS (SELECT CAST(ceil(f * (SELECT count(DISTINCT l_orderkey) FROM lineitem)) AS BIGINT)
AS min_support FROM v)
SELECT min_support, CAST(count(*) AS BIGINT) AS patterns, max(length) AS longest, CAST(sum(support) AS BIGINT) AS total_support
FROM r JOIN t ON support >= min_support GROUP BY 1""")
def threshold_sweep(spark, d):
    import math

    df = basket(spark, d)
    n = dic.transaction_count(df)
    steps = [math.ceil(dic.share_of(f, n)) for f in _SWEEP]
    result = iw.frequent_itemsets(df, min(steps))
    return exp.threshold_sweep(result, steps)
