"""Tables stored by transaction, and tables of thousands of columns."""

import uuid

from pyspark.sql import functions as F
from test_mining import brute, random_rows, table

import itemweave as iw
from itemweave.operators import layouts
from itemweave.operators.dictionary import crisp_occurrences, fuzzy_occurrences
from itemweave.plans.levels import pack_units
from itemweave.sources import writers


def stored(spark, tmp_path, rows):
    name = "t_" + uuid.uuid4().hex
    df = spark.createDataFrame(rows, "txn_id bigint, item string, prob bigint")
    writers.write_stored(df, name, str(tmp_path / name), 3)
    return spark.table(name)


def test_no_shuffle_before_packing(spark, tmp_path):
    df = stored(spark, tmp_path, random_rows(1))
    ranks = spark.createDataFrame([(f"i{k}", k + 1) for k in range(9)], "item string, rank int")
    for occ, value in ((crisp_occurrences(df), False), (fuzzy_occurrences(df), True)):
        rows = occ.join(F.broadcast(ranks), "item").select(
            F.col("txn_id").alias("unit"), "rank", *([F.col("prob").alias("m")] if value else []))
        plan = pack_units(rows, value, placed=True)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SelectedBucketsCount: 3 out of 3" in plan
        assert "Exchange hashpartitioning" in pack_units(rows, value)._jdf.queryExecution().executedPlan().toString()


def test_same_sets_from_a_stored_table(spark, tmp_path):
    rows = random_rows(4)
    df = stored(spark, tmp_path, rows + rows[:30])
    assert table(iw.frequent_itemsets(df, 8, engine="stored")) == brute([(t, i, 1) for t, i, _ in rows], 8)
    assert table(iw.fuzzy_frequent_itemsets(df, 70, min_frequency=5, engine="stored")) == brute(rows, 70, min_frequency=5)


def test_stored_engine_on_any_table(spark):
    rows = random_rows(6)
    df = spark.createDataFrame(rows, "txn_id bigint, item string, prob bigint").repartition(5, "item")
    assert table(iw.fuzzy_frequent_itemsets(df, 70, engine="stored")) == brute(rows, 70)


def test_five_thousand_columns(spark):
    cells = [(line, col, f"x{line}.{col}") for line in range(20) for col in range(line, 5000, 7 + line)] + [(3, 3, "a"), (99, 4999, "z")]
    sparse = spark.createDataFrame(cells, "line_id bigint, col int, item string")
    wide = layouts.from_sparse3(sparse)
    assert len(wide.columns) == 5001
    want = {(line, col): item for line, col, item in cells if item != "a"}
    got = {(r[0], k): v for r in wide.collect() for k, v in enumerate(r[1:]) if v is not None}
    assert got == want
    back = {(r.line_id, r.col): r["item"] for r in layouts.to_sparse3(wide).collect()}
    assert back == want


def test_few_columns_and_none(spark):
    sparse = spark.createDataFrame([(1, 0, "a"), (2, 64, "b")], "line_id bigint, col int, item string")
    assert [tuple(r)[:2] for r in layouts.from_sparse3(sparse, 1).orderBy("line_id").collect()] == [(1, "a"), (2, None)]
    empty = layouts.from_sparse3(sparse.limit(0), 3)
    assert empty.count() == 0 and empty.columns == ["line_id", "c0", "c1", "c2"]
