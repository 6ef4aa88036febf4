"""Miners against brute force over all subsets, on small random data, for every engine."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import itemweave as iw
from itemweave.operators import grouped
from itemweave.operators.dictionary import fuzzy_occurrences
from itemweave.operators.prepare import replicate
from itemweave.plans import bitmaps, levels

TINY = [(1, "a", 5), (1, "b", 3), (1, "c", 2), (2, "a", 7), (2, "b", 4), (3, "b", 6), (3, "c", 9), (4, "a", 1), (4, "c", 8)]


def brute(rows, min_support, min_frequency=1, max_gap=None, min_periodic=0):
    """rows of (txn, item, membership) -> {items: (support, freq[, periodic])}"""
    txns = {}
    for t, i, p in rows:
        if p > 0:
            txns.setdefault(t, {})[i] = max(p, txns.get(t, {}).get(i, 0))
    found = {}
    for t, held in txns.items():
        for k in range(1, len(held) + 1):
            for c in combinations(sorted(held), k):
                found.setdefault(c, []).append((t, min(held[i] for i in c)))
    out = {}
    for c, occ in found.items():
        support, freq = sum(m for _, m in occ), len(occ)
        ids = sorted(t for t, _ in occ)
        if support < min_support or freq < min_frequency:
            continue
        if max_gap is None:
            out[c] = (support, freq)
            continue
        close = sum(b - a <= max_gap for a, b in zip(ids, ids[1:]))
        if close >= min_periodic:
            out[c] = (support, freq, close)
    return out


def table(result, *more):
    rows = result.itemsets.collect()
    got = {tuple(r["items"]): tuple(r[c] for c in ("support", "freq", *more)) for r in rows}
    assert len(got) == len(rows)
    assert all(r["length"] == len(set(r["items"])) for r in rows)
    return got


def random_rows(seed, n_txn=60, n_items=9, density=0.5, top=20):
    rng = random.Random(seed)
    return [(t, f"i{i}", rng.randint(0, top)) for t in range(1, n_txn + 1) for i in range(n_items)
            if rng.random() < density * (i + 2) / n_items]


@pytest.fixture(params=["rows", "cut"])
def plan(request, monkeypatch):
    """The loop as it is, and with states that are split into head ranges and written at every level."""
    if request.param == "cut":
        monkeypatch.setattr(levels, "HEADS_PER_ROW", 2)
        monkeypatch.setattr(levels, "LEVELS_PER_CUT", 1)
        monkeypatch.setattr(levels, "BITMAP_LONGS", 3)
        monkeypatch.setattr(bitmaps, "HEADS_PER_ROW", 2)
        monkeypatch.setattr(bitmaps, "SETS_PER_PASS", 7)
        monkeypatch.setattr(bitmaps, "PAIR_BITS", 200)
        monkeypatch.setattr(bitmaps, "PARTIAL", 5)
    return request.param


def crisp_frame(spark, rows):
    return spark.createDataFrame([(t, i) for t, i, _ in rows], "txn_id bigint, item string")


def fuzzy_frame(spark, rows, kind="bigint"):
    cast = float if kind == "double" else int
    return spark.createDataFrame([(t, i, cast(p)) for t, i, p in rows], f"txn_id bigint, item string, prob {kind}")


@pytest.mark.parametrize("engine", ["join", "bitset", "bitmap"])
def test_crisp_every_plan(spark, plan, engine):
    rows = [(t, i, 1) for t, i, _ in random_rows(1)]
    got = table(iw.frequent_itemsets(crisp_frame(spark, rows + rows[:30]), 8, engine=engine))
    assert got == brute(rows, 8)


def test_bitset_uses_the_top_bit(spark):
    rows = [(t, i, 1) for t, i, _ in random_rows(2, n_txn=200, n_items=7, density=0.9)]
    assert table(iw.frequent_itemsets(crisp_frame(spark, rows), 5, engine="bitset")) == brute(rows, 5)


@pytest.mark.parametrize("entries", [1 << 22, 500])
def test_bitmap_over_many_runs_and_sparse_ids(spark, monkeypatch, entries):
    """Several runs of transactions, listed and bit containers, ids with holes and ids that are text."""
    monkeypatch.setattr(bitmaps, "ENTRIES", entries)
    rng = random.Random(11)
    rows = [(t * 10**12 - 5 * 10**15, f"i{i}", 1) for t in range(9_000) for i in range(6) if rng.random() < 0.6 / (i + 1) ** 2]
    rows += [(7 * 10**15, f"i{i}", 1) for i in range(6)]
    frame = crisp_frame(spark, rows).repartition(5)
    want = brute(rows, 20)
    assert table(iw.frequent_itemsets(frame, 20, engine="bitmap")) == want
    text = frame.withColumn("txn_id", F.concat(F.lit("t"), "txn_id"))
    assert table(iw.frequent_itemsets(text, 20, engine="bitmap")) == want


def test_bitmap_runs_without_a_frequent_pair(spark, monkeypatch):
    """Runs that hold frequent items, but no two of them that are frequent together."""
    monkeypatch.setattr(bitmaps, "RANGE", 64)
    monkeypatch.setattr(bitmaps, "LISTED", 4)
    monkeypatch.setattr(bitmaps, "_WORDS", 1)
    rows = [(t, i, 1) for t in range(60) for i in "abc"] + [(1000 + 2 * t + k, "de"[k], 1) for t in range(300) for k in (0, 1)]
    rows += [(5000 + t, i, 1) for t in range(5) for i in "de"]
    got = table(iw.frequent_itemsets(crisp_frame(spark, rows), 40, engine="bitmap"))
    assert got == brute(rows, 40)


def test_containers_take_the_smaller_form(spark):
    rows = [(t, 1 + (t % 16 == 0)) for t in range(bitmaps.RANGE)] + [(t, 3) for t in range(0, bitmaps.RANGE, 2)]
    state = bitmaps.BitmapSteps().pack(spark.createDataFrame(rows, "unit bigint, rank int").repartition(1))
    kinds = {r["kind"]: (r["transactions"], r["bytes"] / r["transactions"]) for r in bitmaps.sizes(state).collect()}
    assert sum(n for n, _ in kinds.values()) == len(rows)
    assert kinds["list"][1] == 2 and kinds["bits"][1] < 1


def test_pairs_are_pruned_at_any_number(spark, monkeypatch):
    """Candidates with a pair that is not frequent are not counted; ranges of the pair table change nothing."""
    # A rare hub goes with each of ten items, which hardly ever meet each other.
    baskets = [("hub", f"y{t % 10}") for t in range(350)] + [("hub", "y1", "y2", "y3")] * 31 + [(f"y{i}", f"y{i + 1}") for i in range(9)]
    baskets += [("hub", f"y{t % 10}", f"y{(t + 3) % 10}") for t in range(20)] + [(f"y{t % 10}",) for t in range(5_000)]
    frame = crisp_frame(spark, [(t, i, 1) for t, b in enumerate(baskets) for i in b])
    seen = {}
    for name, longs, top in (("one range", 4_000_000, 2_000_000), ("ranges", 3, 2_000_000), ("no broadcast", 4_000_000, 5), ("off", None, 2_000_000)):
        with monkeypatch.context() as m:
            m.setattr(levels, "BROADCAST_SETS", top)
            if longs is None:
                m.setattr(levels, "pair_table", lambda *_: [None])
            else:
                m.setattr(levels, "BITMAP_LONGS", longs)
            result = iw.frequent_itemsets(frame, 30)
            seen[name] = (table(result), [s["candidates"] for s in result.stats])
    assert len({str(sorted(t.items())) for t, _ in seen.values()}) == 1
    assert seen["one range"][1] == seen["ranges"][1] == seen["no broadcast"][1]
    assert sum(seen["one range"][1]) < sum(seen["off"][1])


@pytest.mark.parametrize("engine", ["fpgrowth", "grouped"])
def test_crisp_other_engines(spark, engine):
    rows = [(t, i, 1) for t, i, _ in random_rows(3)]
    df = crisp_frame(spark, rows)
    assert table(iw.frequent_itemsets(df, 7, engine=engine)) == brute(rows, 7)
    short = {c: v for c, v in brute(rows, 7).items() if len(c) <= 3}
    assert table(iw.frequent_itemsets(df, 7, max_len=3, engine=engine)) == short


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_fuzzy_every_plan(spark, plan, kind):
    rows = random_rows(4)
    assert table(iw.fuzzy_frequent_itemsets(fuzzy_frame(spark, rows, kind), 60)) == brute(rows, 60)


def test_fuzzy_dual_every_plan(spark, plan):
    rows = random_rows(5)
    got = table(iw.fuzzy_frequent_itemsets(fuzzy_frame(spark, rows), 40, min_frequency=10, max_len=4))
    assert got == {c: v for c, v in brute(rows, 40, 10).items() if len(c) <= 4}


@pytest.mark.parametrize("class_rows", [10**6, 60, 0])
def test_grouped_hands_over_classes_of_any_size(spark, monkeypatch, class_rows):
    monkeypatch.setattr(grouped, "CLASS_ROWS", class_rows)
    rows = random_rows(6)
    got = table(iw.fuzzy_frequent_itemsets(fuzzy_frame(spark, rows), 40, min_frequency=5, engine="grouped"))
    assert got == brute(rows, 40, 5)


@pytest.mark.parametrize("gap", [1, 2, 70])
def test_periodic(spark, plan, gap):
    rows = [(t * 37 % 5000, i, p) for t, i, p in random_rows(7, n_txn=80, n_items=5)]
    got = table(iw.fuzzy_periodic_frequent_itemsets(fuzzy_frame(spark, rows), 30, 1, gap), "periodic_freq")
    assert got == brute(rows, 30, 1, gap, 1)


def test_periodic_known_gaps_and_many_rounds(spark):
    ids = [1, 2, 3, 10, 11, 10**9, 10**9 + 1]
    df = spark.createDataFrame([(t, "x") for t in ids], "txn_id bigint, item string")
    assert table(iw.fuzzy_periodic_frequent_itemsets(df, 1, 1, 1), "periodic_freq") == {("x",): (7, 7, 4)}


def test_tiny_fixture(spark):
    df = fuzzy_frame(spark, TINY)
    assert table(iw.fuzzy_frequent_itemsets(df, 7)) == {
        ("a",): (13, 3), ("b",): (13, 3), ("c",): (19, 3), ("a", "b"): (7, 2), ("b", "c"): (8, 2)}
    assert len(table(iw.fuzzy_frequent_itemsets(df, 2, min_frequency=2))) == 6
    assert len(table(iw.frequent_itemsets(df, 2))) == 6
    assert table(iw.fuzzy_frequent_itemsets(df, 7, scaling_factor=10))[("c",)] == (1.9, 3)
    tripled = table(iw.fuzzy_frequent_itemsets(replicate(df, 3), 21))
    assert tripled == {c: (3 * s, 3 * f) for c, (s, f) in brute(TINY, 7).items()}


@pytest.mark.parametrize("value", [2, 0.5, "2", "0.5"])
def test_thresholds(spark, value):
    assert table(iw.frequent_itemsets(crisp_frame(spark, TINY), value)) == \
        {c: (f, f) for c, (_, f) in brute(TINY, 0, 2).items()}


def test_empty_and_single(spark):
    df = crisp_frame(spark, TINY)
    for engine in ("join", "bitset", "bitmap", "fpgrowth", "grouped"):
        assert table(iw.frequent_itemsets(df, 100, engine=engine)) == {}
    only = table(iw.frequent_itemsets(df, 3))
    assert set(only) == {("a",), ("b",), ("c",)}
    assert table(iw.frequent_itemsets(df.limit(0), 1)) == {}


def test_zero_membership_is_absent_and_max_or_last(spark):
    df = spark.createDataFrame([(1, "a", 0, 0), (1, "b", 5, 1), (2, "a", 7, 0), (2, "a", 3, 1)],
                               "txn_id bigint, item string, prob bigint, pos int")
    assert table(iw.fuzzy_frequent_itemsets(df, 1)) == {("a",): (7, 1), ("b",): (5, 1)}
    assert table(iw.fuzzy_frequent_itemsets(df, 1, on_duplicate="last")) == {("a",): (3, 1), ("b",): (5, 1)}


def test_downward_closure_and_sweep(spark):
    rows = random_rows(8)
    low = table(iw.fuzzy_frequent_itemsets(fuzzy_frame(spark, rows), 50))
    for c, (s, _) in low.items():
        assert all(low[p][0] >= s for p in combinations(c, len(c) - 1) if p)
    high = table(iw.fuzzy_frequent_itemsets(fuzzy_frame(spark, rows), 90))
    assert high == {c: v for c, v in low.items() if v[0] >= 90}


def test_one_transaction_holds_most_rows(spark, monkeypatch):
    """A unit longer than the head range, next to short ones; wide dictionary with bitmaps."""
    monkeypatch.setattr(levels, "HEADS_PER_ROW", 16)
    rows = [(1, f"w{i:03d}", 1) for i in range(150)] + [(t, f"w{(t * 7 + j) % 150:03d}", 1) for t in range(2, 40) for j in range(4)]
    got = table(iw.frequent_itemsets(crisp_frame(spark, rows), 2, max_len=3))
    wanted = {}
    held = {}
    for t, i, _ in rows:
        held.setdefault(t, set()).add(i)
    for t in range(2, 40):
        for k in (1, 2, 3):
            for c in combinations(sorted(held[t]), k):
                n = sum(set(c) <= h for h in held.values())
                if n >= 2:
                    wanted[c] = (n, n)
    assert got == wanted


def test_bad_arguments(spark):
    df = crisp_frame(spark, TINY)
    with pytest.raises(ValueError):
        iw.frequent_itemsets(df, 1, engine="none")
    with pytest.raises(ValueError):
        iw.frequent_itemsets(df.drop("item"), 1)
    with pytest.raises(ValueError):
        iw.fuzzy_frequent_itemsets(df, 1)
    with pytest.raises(ValueError):
        iw.frequent_itemsets(df.withColumn("txn_id", F.col("txn_id").cast("string")), 1, engine="bitset")


def test_result_and_base_class(spark, tmp_path):
    result = iw.fuzzy_frequent_itemsets(fuzzy_frame(spark, TINY), 7)
    assert result.count() == 5 and result.to_dict()[("a", "b")] == 7
    assert {r["Patterns"] for r in result.to_frame("+").collect()} == {"a", "b", "c", "a+b", "b+c"}
    assert [(r["k"], r["frequent"]) for r in result.levels.orderBy("k").collect()][:2] == [(1, 3), (2, 2)]
    assert "Patterns Found: 5" in result.summary()

    class Singles(iw.Miner):
        def _mine(self):
            return self.df.groupBy("item").agg(F.count("*").alias("support")).select(
                F.array("item").alias("items"), F.lit(1).alias("length"), "support", F.col("support").alias("freq"))

    miner = Singles(crisp_frame(spark, TINY))
    with pytest.raises(RuntimeError):
        miner.get_pattern_count()
    miner.mine()
    assert miner.get_pattern_count() == 3 and miner.get_execution_time() >= 0
    miner.save(str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a\t3", "b\t3", "c\t3"]


@pytest.mark.parametrize("kind", ["float", "decimal(5,2)", "double"])
@pytest.mark.parametrize("engine", ["join", "grouped"])
def test_fractional_memberships_keep_their_sums(spark, kind, engine):
    rows = spark.createDataFrame([(1, "a", "0.5"), (2, "a", "0.7"), (1, "b", "0.6"), (2, "b", "0.9"), (2, "c", "0.1")], "txn_id bigint, item string, prob string")
    got = iw.fuzzy_frequent_itemsets(rows.withColumn("prob", F.col("prob").cast(kind)), 1, engine=engine)
    assert {tuple(r["items"]): round(float(r["support"]), 6) for r in got.itemsets.collect()} == {("a",): 1.2, ("b",): 1.5, ("a", "b"): 1.2}


@pytest.mark.parametrize("engine", ["join", "bitset", "bitmap", "fpgrowth", "grouped"])
def test_proportion_on_the_boundary_and_null_items(spark, engine):
    rows = [(t, "x") for t in range(7)] + [(t, "all") for t in range(100)] + [(200 + t, None) for t in range(50)]
    df = spark.createDataFrame(rows, "txn_id bigint, item string")
    got = {tuple(r["items"]) for r in iw.frequent_itemsets(df, 0.07, engine=engine).itemsets.collect()}
    assert got == {("x",), ("all",), ("all", "x")}


def test_nan_is_absent(spark):
    rows = [(1, "a", float("nan")), (1, "a", 0.25), (2, "b", float("nan")), (2, "c", 0.5)]
    df = spark.createDataFrame(rows, "txn_id bigint, item string, prob double")
    assert {tuple(r["items"]): r["support"] for r in iw.fuzzy_frequent_itemsets(df, 0.01).itemsets.collect()} == {("c",): 0.5, ("a",): 0.25}


def test_periodic_on_both_sides_of_zero(spark):
    ids = [-130, -129, -66, -65, -64, -1, 0, 1, 63, 64, 200]
    df = spark.createDataFrame([(t, "a", 100) for t in ids], "txn_id bigint, item string, prob int").withColumn("prob", F.col("prob").cast("tinyint"))
    row, = iw.fuzzy_periodic_frequent_itemsets(df, 1, 1, 2).itemsets.collect()
    assert (row["support"], row["freq"], row["periodic_freq"]) == (1100, 11, sum(b - a <= 2 for a, b in zip(ids, ids[1:])))


@pytest.mark.parametrize("engine", ["join", "bitset", "bitmap", "fpgrowth", "grouped"])
def test_rare_items_go_before_the_shuffle(spark, engine):
    """Items with too few occurrences, repeats included, are no candidates; the sets and the share of transactions stay."""
    rows = [(t, f"rare{t}-{j}") for t in range(40) for j in range(5)] + [(t, i) for t in range(30) for i in ("a", "b", "a")]
    rows += [(1, "often")] * 20 + [(None, "a")] * 9 + [(50, None)]
    result = iw.frequent_itemsets(spark.createDataFrame(rows, "txn_id long, item string"), 0.5, engine=engine)
    assert table(result) == {("a",): (30, 30), ("b",): (30, 30), ("a", "b"): (30, 30)}
    if engine == "join":
        assert result.levels.where("k = 1").first()["candidates"] == 3


def test_fuzzy_rows_move_once(spark):
    """After the rows are placed by transaction, or by group of ids, neither deduplicating nor packing shuffles them again."""
    rows = spark.range(200).selectExpr("id % 50 AS txn_id", "concat('i', id % 7) AS item", "id % 5 AS prob")
    for group, extra in ((None, []), (F.shiftright("txn_id", 2), ["grp"])):
        occ = fuzzy_occurrences(rows, parts=3, group=group).select(*extra, F.col("txn_id").alias("unit"), F.length("item").alias("rank"), F.col("prob").alias("m"))
        plan = levels.pack_units(occ, True, group=None if group is None else F.shiftright("unit", 2), placed=True)
        assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_all_pairs_frequent(spark, monkeypatch):
    """The state after the pairs keeps all later items; sets found are the same, with and without infrequent pairs among them."""
    rows = random_rows(11, n_txn=80, n_items=8, density=1.2)
    used = []
    monkeypatch.setattr(levels, "dense_state", lambda *a, f=levels.dense_state: used.append(1) or f(*a))
    df = spark.createDataFrame(rows, "txn_id long, item string, prob long")
    assert table(iw.fuzzy_frequent_itemsets(df, 60)) == brute(rows, 60)
    assert table(iw.fuzzy_periodic_frequent_itemsets(df, 60, 3, 4), "periodic_freq") == brute(rows, 60, max_gap=4, min_periodic=3)
    assert table(iw.frequent_itemsets(df, 9)) == {k: (v[1], v[1]) for k, v in brute([(t, i, 1) for t, i, _ in rows], 9).items()}
    assert used
