"""Fixed point without loss, offsets by ranges, and the smaller tools on tables."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import itemweave as iw
from itemweave.functions import columns
from itemweave.operators import experiments, mining, prepare, textprofile
from itemweave.plans import numbering
from itemweave.sources import readers


@pytest.mark.parametrize("values, scale, kind", [
    (["0.7", "4.35", "1", "0.125", "-2.5", None], 10**3, "bigint"),
    (["0.1234567890123456789012345", "1"], 10**25, "decimal(38,0)"),
    (["1e-20", "2.5E-3", " 7 "], 10**20, "decimal(38,0)"),
    (["1e25", "3"], 1, "decimal(38,0)"),
    (["1e25", "1e-20", "-0.1234567890123456789012345"], 10**25, "string"),
    (["0", "0.000", "000", ".5", "5.", "+1.5e1"], 10**3, "bigint"),
])
def test_fixed_point_of_any_length(spark, values, scale, kind):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, prob string")
    out, got = prepare.to_fixed_point(df)
    assert got == scale and out.schema["prob"].dataType.simpleString() == kind
    rows = {r["k"]: r["prob"] for r in out.collect()}
    for k, v in enumerate(values):
        assert rows[k] is None if v is None else int(rows[k]) == int(Decimal(v.strip()).scaleb(len(str(scale)) - 1)), v


@pytest.mark.parametrize("kind, values, want", [
    ("double", [1e-5, 0.5, 3.0, 1e20], (5, [1, 50000, 300000, 10**25])), ("decimal(10,4)", ["1.5000", "2.25"], (2, [150, 225])), ("float", [0.5, 0.25], (2, [50, 25]))])
def test_fixed_point_of_numbers(spark, kind, values, want):
    df = spark.createDataFrame([(k, str(v)) for k, v in enumerate(values)], "k int, prob string").withColumn("prob", F.col("prob").cast(kind))
    out, scale = prepare.to_fixed_point(df)
    assert (prepare.max_decimals(df), [int(r["prob"]) for r in out.orderBy("k").collect()]) == want and scale == 10**want[0]


def test_text_that_is_no_number_is_an_error(spark):
    for text in ("x", "1.2.3", ".", "", "1e", "NaN"):
        with pytest.raises(Exception, match="not a number"):
            prepare.max_decimals(spark.createDataFrame([(text,)], "prob string"))


def test_numbers_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(numbering, "_RANGE_BITS", 1)
    df = spark.range(500).withColumn("v", (F.col("id") * 37) % 500).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbering.number_rows(df, [F.col("v")], "n", first=0)
        assert got.where("n <> v").count() == 0 and got.count() == 500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lines_are_numbered_without_broadcast_hints(spark, tmp_path):
    for f in range(5):
        (tmp_path / f"f{f}.txt").write_text("".join(f"{f},{k}\n" for k in range(20 + f)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30")
    try:
        lines = numbering.number_lines(readers.read_lines(spark, str(tmp_path)), "line", first=0)
        got = [r["value"] for r in lines.orderBy("line").collect()]
        assert got == [f"{f},{k}" for f in range(5) for k in range(20 + f)]
        assert [r["value"] for r in textprofile.preview(lines, 3).collect()] == got[:3]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_largest_rows_and_powers(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (4, 7), (5, None)], "k int, v int")
    assert sorted(r["k"] for r in experiments.largest_rows(df, "v", 2).collect()) == [2, 3, 4]
    powers = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 64, 65)], "n int").select(columns.next_power_of_two(F.col("n"))).collect()
    assert [r[0] for r in powers] == [None, 1, 2, 4, 64, 128]


def test_a_periodic_algorithm_can_be_registered(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "txn_id bigint, item string")
    mining.PERIODIC_ENGINES["again"] = mining.PERIODIC_ENGINES["join"]
    try:
        assert iw.fuzzy_periodic_frequent_itemsets(df, 1, 1, 1, engine="again").count() == 1
    finally:
        del mining.PERIODIC_ENGINES["again"]
    with pytest.raises(ValueError):
        iw.fuzzy_periodic_frequent_itemsets(df, 1, 1, 1, engine="again")


def test_closed_results_leave_no_files(spark):
    from pathlib import Path

    result = iw.frequent_itemsets(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "txn_id bigint, item string"), 1)
    root = Path(result.workspace.root.removeprefix("file:"))
    assert result.itemsets.count() == 3 and root.exists()
    result.close()
    assert not root.exists()
