"""Readers, writers, preparation, layouts, profiles and experiment tables on small fixtures."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from itemweave.functions import human_bytes, split_literal, trim_trailing, trimmed_mean
from itemweave.operators import candidates as cand
from itemweave.operators import dictionary as dic
from itemweave.operators import experiments as exp
from itemweave.operators import layouts, prepare, textprofile
from itemweave.plans import numbering
from itemweave.sources import readers, writers


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=lambda r: [(x is None, x) for x in r])


def test_fuzzy_text(spark, tmp_path):
    path = put(tmp_path, "t.txt", "a\tb\tc:5\t3\t2\r\n\na\tb:7\t4\t\nno colon here\nb\tc\t:6\t9\n")
    long = readers.load_transactions(spark, path, fuzzy=True)
    assert rows(long, "txn_id", "item", "prob") == [
        (1, "a", 5), (1, "b", 3), (1, "c", 2), (2, "a", 7), (2, "b", 4), (3, "b", 6), (3, "c", 9)]


def test_list_length_mismatch(spark, tmp_path):
    lists = readers.read_fuzzy_text(spark, put(tmp_path, "t.txt", "a\tb\tc:1\t2\nx:3\n"))
    assert rows(readers.fuzzy_long(lists), "item", "prob") == [("a", 1), ("b", 2), ("x", 3)]
    assert rows(readers.fuzzy_long(lists, on_mismatch="skip"), "item", "prob") == [("x", 3)]
    with pytest.raises(PySparkException):
        readers.fuzzy_long(lists, on_mismatch="error").collect()
    with pytest.raises(ValueError):
        readers.fuzzy_long(lists, on_mismatch="other")


def test_values_must_be_numbers(spark, tmp_path):
    path = put(tmp_path, "t.txt", "a\tb:1\tx\n")
    with pytest.raises(PySparkException):
        readers.load_transactions(spark, path, fuzzy=True).collect()


@pytest.mark.parametrize("sep", ["|", ".", " ", ",", "\t"])
def test_separators_are_literal(spark, tmp_path, sep):
    path = put(tmp_path, "t.txt", f"a{sep}b{sep}{sep}\nc{sep}a\n")
    assert rows(readers.load_transactions(spark, path, sep=sep)) == [(1, "a"), (1, "b"), (2, "a"), (2, "c")]
    one = spark.createDataFrame([(f"x{sep}y{sep}",)], "v string")
    assert one.select(split_literal(trim_trailing(F.col("v"), sep), sep)).first()[0] == ["x", "y"]


def test_line_numbers_over_splits_and_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for part in range(3):
        (folder / f"part-{part}.txt").write_text("".join(f"n{part * 2000 + i:05d}\n\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = rows(readers.load_transactions(spark, str(folder)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i + 1, f"n{i:05d}") for i in range(6000)]


def test_number_rows_and_dictionary_by_sort(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    got = numbering.number_rows(df, [F.col("v").desc()], "n", first=0)
    assert got.where("n <> 4999 - v").count() == 0 and got.count() == 5000
    data = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (2, "y"), (3, "z"), (3, "y"), (4, "x")], "txn_id bigint, item string")
    assert rows(dic.item_dictionary(data, 2)) == [("x", 1, 3, 3), ("y", 2, 2, 2)]
    assert rows(dic.encode(data, dic.item_dictionary(data, 3))) == [(1, 1), (2, 1), (4, 1)]


def test_parquet_checks(spark, tmp_path):
    p = str(tmp_path / "x.parquet")
    spark.createDataFrame([("a", 1.5, 0), ("b", 2.0, 1)], "item string, prob double, __index_level_0__ bigint").write.parquet(p)
    assert rows(readers.load_transactions(spark, p, fuzzy=True)) == [(1, "a", 1.5), (2, "b", 2.0)]
    with pytest.raises(ValueError):
        readers.load_transactions(spark, p)
    with pytest.raises(FileNotFoundError):
        readers.load_transactions(spark, str(tmp_path / "none.parquet"))


def test_fixed_point_is_exact(spark):
    df = spark.createDataFrame([("0.7",), ("4.35",), ("1",), ("0.125",)], "prob string")
    scaled, scale = prepare.to_fixed_point(df)
    assert scale == 1000 and sorted(r[0] for r in scaled.collect()) == [125, 700, 1000, 4350]
    doubles, scale = prepare.to_fixed_point(df.select(F.col("prob").cast("double").alias("prob")))
    assert scale == 1000 and sorted(r[0] for r in doubles.collect()) == [125, 700, 1000, 4350]
    whole, scale = prepare.to_fixed_point(spark.createDataFrame([("3",), ("12",)], "prob string"))
    assert scale == 1 and sorted(r[0] for r in whole.collect()) == [3, 12]


def test_text_round_trip_and_replication(spark, tmp_path):
    df = spark.createDataFrame([(5, "b", 2, 1), (5, "a", 3, 0), (9, "c", 4, 0)], "txn_id bigint, item string, prob bigint, pos int")
    path, more = str(tmp_path / "t"), str(tmp_path / "t3")
    prepare.write_transaction_text(df, path)
    assert rows(spark.read.text(path)) == [("a\tb:3\t2",), ("c:4",)]
    prepare.replicate_text(spark, path, 3, more)
    back = prepare.text_to_long(spark, more)
    assert rows(back, "txn_id", "item", "prob") == sorted(
        (2 * c + t, i, float(p)) for c in range(3) for t, i, p in [(1, "a", 3), (1, "b", 2), (2, "c", 4)])
    assert prepare.replicate(df, 2).select("txn_id").distinct().count() == 4


def test_wide_and_sparse(spark, tmp_path):
    path = put(tmp_path, "w.csv", "1,2,3\n4\n,\n5,,6\n")
    wide = readers.read_wide(spark, path, 3, line_ids=True)
    sparse = layouts.to_sparse3(wide)
    assert rows(sparse) == [(0, 0, "1"), (0, 1, "2"), (0, 2, "3"), (1, 0, "4"), (3, 0, "5"), (3, 2, "6")]
    assert rows(layouts.to_sparse2(wide))[3] == (1, "4")
    assert [tuple(r) for r in layouts.from_sparse3(sparse).orderBy("line_id").collect()] == [
        (0, "1", "2", "3"), (1, "4", None, None), (3, "5", None, "6")]
    assert [tuple(r) for r in layouts.from_sparse2(sparse, "col").orderBy("line_id").collect()] == [
        (0, "1", "2", "3"), (1, "4", None, None), (3, "5", "6", None)]
    assert rows(readers.read_wide(spark, path)) == rows(wide.drop("line_id"))
    with pytest.raises(ValueError):
        readers.read_wide(spark, path, 2)
    writers.write_wide_csv(wide.drop("line_id"), str(tmp_path / "back"))
    assert rows(spark.read.text(str(tmp_path / "back"))) == [("",), ("1,2,3",), ("4",), ("5,,6",)]
    assert layouts.from_sparse2(sparse, order="col").columns == ["line_id", "c0", "c1", "c2"]


def test_profile_and_parse(spark, tmp_path):
    text = spark.read.text(put(tmp_path, "p.txt", "1,-2,x\n+3, 4z,\n12"))
    assert tuple(textprofile.profile_delimited(text).first()) == (3, 7, 1, 3, 5)
    assert sorted(r["value"] for r in textprofile.parse_ints(text).collect()) == [-2, 0, 1, 3, 4, 12]
    assert rows(textprofile.items_per_line(text)) == [(1, 1), (3, 2)]
    assert textprofile.preview(text).count() == 2


def test_writers(spark, tmp_path):
    ragged = spark.createDataFrame([(0, [1, 2, 3]), (1, [4])], "row_index bigint, values array<bigint>")
    for codec in ("none", "snappy", "zstd", "lz4", "gzip"):
        p = str(tmp_path / codec)
        writers.write_wide_parquet(ragged, p, 3, codec)
        assert rows(spark.read.parquet(p).fillna(-1)) == [(1, 2, 3), (4, -1, -1)]
    with pytest.raises(ValueError):
        writers.write_wide_parquet(ragged, str(tmp_path / "narrow"), 2)
    writers.write_ragged_csv(ragged, str(tmp_path / "csv"), compression="gzip")
    assert rows(spark.read.text(str(tmp_path / "csv"))) == [("1,2,3",), ("4",)]
    writers.write_long_values(ragged, str(tmp_path / "long"))
    assert rows(spark.read.parquet(str(tmp_path / "long"))) == [(0, 1), (0, 2), (0, 3), (1, 4)]
    with pytest.raises(ValueError):
        writers.write_long_parquet(ragged, str(tmp_path / "no"), "zip")
    sets = spark.createDataFrame([(["b"], 2), (["a", "c"], 3), (["aa"], 1)], "items array<string>, support bigint")
    assert [r[0] for r in writers.itemset_lines(sets, "sorted").collect()] == ["aa:1", "b:2", "a\tc:3"]
    assert [r[0] for r in writers.itemset_lines(sets, "by_text").collect()] == ["b:2", "aa:1", "a\tc:3"]
    with pytest.raises(ValueError):
        writers.itemset_lines(sets, "other")


def test_candidates_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(cand, "CLASS_PART", 2)
    names = [f"n{i}" for i in range(9)]
    singles = spark.createDataFrame([([n],) for n in names], "items array<string>")
    pairs = cand.candidates(singles)
    assert sorted(tuple(r[0]) for r in pairs.collect()) == [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    some = pairs.where("not array_contains(items, 'n0') or not array_contains(items, 'n1')")
    triples = cand.candidates(some, some)
    assert triples.count() == 84 - 7


def test_count_support_of_absent_sets(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 5), (2, "a", 4)], "txn_id bigint, item string, prob bigint")
    asked = spark.createDataFrame([(["b", "a"],), (["a"],), (["a", "z"],)], "items array<string>")
    got = {tuple(r["items"]): (r["support"], r["freq"]) for r in cand.count_support(df, asked, fuzzy=True).collect()}
    assert got == {("a", "b"): (2, 1), ("a",): (6, 2), ("a", "z"): (0, 0)}


def test_trimmed_mean_and_bytes(spark):
    df = spark.createDataFrame([("one", 1.0), ("two", 1.0), ("two", 4.0), ("three", 1.0), ("three", 5.0), ("three", 9.0),
                                *[("five", float(v)) for v in (1, 2, 3, 4, 100)]], "k string, seconds double")
    got = dict(df.groupBy("k").agg(trimmed_mean(F.col("seconds"))).collect())
    assert got == {"one": 1.0, "two": 2.5, "three": 5.0, "five": 3.0}
    sizes = spark.createDataFrame([(0,), (1023,), (1536,), (5 * 1024**3,)], "n bigint")
    assert [r[0] for r in sizes.select(human_bytes(F.col("n"))).collect()] == ["0.0B", "1023.0B", "1.5KiB", "5.0GiB"]


def test_logs_and_tables(spark, tmp_path):
    put(tmp_path, "a.out", "--- X Results ---\nExecution Time: 1.5 seconds\nPeak CPU Memory Usage: 20.25 MB\nPatterns Found: 7\n")
    put(tmp_path, "b.out", "Total Patterns Found: 9\nExecution Time: 2 seconds\nPeak GPU (driver) Used: 3.5 MB\n")
    logs = exp.read_logs(spark, str(tmp_path / "*.out"))
    got = exp.extract_metrics(logs).orderBy("path").select("exec_time", "cpu_mem_mb", "gpu_mem_mb", "patterns_found").collect()
    assert [tuple(r) for r in got] == [(1.5, 20.25, None, 7.0), (2.0, None, 3.5, 9.0)]
    metrics = exp.metrics_frame(spark, [("d", 1, "x", s, 10, s / 2, 0.0, None, s * 3) for s in (10, 20)]
                                + [("d", 1, "y", 20, 10, 4.0, 0.0, None, 5)])
    assert [tuple(r) for r in exp.comparison_table(metrics, ["x", "y"]).collect()] == [
        (20, 10.0, 4.0, 60, 5), (10, 5.0, None, 30, None)]
    assert exp.largest([5, 9, 7]) == [9]
