"""Prefix trees by groups of items, difference lists and the statistics of the depth-first engines, against the level loop and brute force."""

import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

import itemweave as iw
from itemweave.operators import grouped
from itemweave.plans import fptrees
from test_mining import brute, random_rows, table


def crisp(rows):
    return [(t, i, 1) for t, i, p in rows]


@pytest.mark.parametrize("cells, max_len", [(1, None), (1, 3), (60, None), (60, 2), (4_000_000, None), (4_000_000, 4), (4_000_000, 1)])
def test_trees_at_any_group_size(spark, monkeypatch, cells, max_len):
    """From every rank too heavy for a task, down to no items left, to one group of all."""
    monkeypatch.setattr(fptrees, "GROUP_CELLS", cells)
    rows = random_rows(3, n_txn=50, n_items=7, density=0.8)
    df = spark.createDataFrame(rows + rows[:40], "txn_id bigint, item string, prob bigint")
    result = iw.frequent_itemsets(df, 9, max_len=max_len, engine="fpgrowth")
    want = {c: v for c, v in brute(crisp(rows), 9).items() if max_len is None or len(c) <= max_len}
    assert table(result) == want and result.count() == len(want)


@pytest.mark.parametrize("engine, light", [("fpgrowth", 60), ("fpgrowth", 500_000), ("grouped", 0), ("grouped", 60), ("grouped", 500_000),
                                           ("bitmap", 0), ("bitset", 0)])
def test_levels_of_every_engine(spark, monkeypatch, engine, light):
    """With classes of 60 rows the loop keeps few sets of a level, fewer than a longer one has subsets."""
    monkeypatch.setattr(grouped, "CLASS_ROWS", light)
    monkeypatch.setattr(fptrees, "GROUP_CELLS", max(light, 1))
    df = spark.createDataFrame(random_rows(5, density=0.9), "txn_id bigint, item string, prob bigint")

    def frequent(result):
        return {r["k"]: r["frequent"] for r in result.levels.collect() if r["frequent"]}

    def enough(result):
        return all(r["candidates"] >= r["frequent"] and r["occurrences"] >= 12 * r["frequent"] for r in result.levels.collect())

    got = iw.frequent_itemsets(df, 12, engine=engine)
    want = brute(crisp(random_rows(5, density=0.9)), 12)
    assert table(got) == want and frequent(got) == Counter(len(c) for c in want)
    assert enough(got) and got.count() == got.itemsets.count()


@pytest.mark.parametrize("light", [0, 30, 500_000])
@pytest.mark.parametrize("kind", ["bigint", "decimal(9,2)", "double"])
def test_losses_of_memberships(spark, monkeypatch, kind, light):
    """Nearly full transactions, whose losses are shorter than their lists."""
    monkeypatch.setattr(grouped, "CLASS_ROWS", light)
    rng = random.Random(8)
    rows = [(t, f"i{i}", rng.choice([0, 4, 4, 4, 4, 3])) for t in range(40) for i in range(6)]
    df = spark.createDataFrame(rows, "txn_id bigint, item string, prob bigint").withColumn("prob", F.col("prob").cast(kind))
    got = table(iw.fuzzy_frequent_itemsets(df, 40, min_frequency=11, engine="grouped"))
    assert got == brute(rows, 40, min_frequency=11)


@pytest.mark.parametrize("make", [int, Decimal])
def test_lists_and_losses_agree(make, monkeypatch):
    rng = random.Random(2)
    held = {i: {t: rng.randint(1, 5) for t in range(200) if rng.random() < 0.9} for i in range(1, 8)}

    def members():
        values = {i: [make(v) for v in h.values()] for i, h in held.items()}
        return [(i, np.array(list(h)), np.array(values[i], object if make is Decimal else np.int64)) for i, h in held.items()]

    used = []
    losses = grouped.ClassSearch.losses
    monkeypatch.setattr(grouped.ClassSearch, "losses", lambda self, *a: (used.append(1), losses(self, *a)))
    a = grouped.ClassSearch(make(150), 60, None)
    a.lists((), members())
    assert used
    monkeypatch.setattr(grouped, "_loss", lambda ms, hit, low: (np.zeros(10_000, int), ms, hit))  # never shorter
    b = grouped.ClassSearch(make(150), 60, None)
    b.lists((), members())
    assert sorted(a.sets) == sorted(b.sets) and a.tested == b.tested and len(a.sets) > 50


def test_no_transaction(spark):
    df = spark.createDataFrame([], "txn_id bigint, item string")
    for engine in ("fpgrowth", "grouped"):
        result = iw.frequent_itemsets(df, 1, engine=engine)
        assert result.itemsets.count() == 0 and result.count() == 0


def test_tree_merges_equal_beginnings():
    tree = fptrees.Tree(np.array([1, 2, 3, 1, 2, 4, 2]), np.array([3, 3, 1, 0]), np.array([5, 1, 2, 9]))
    assert tree.rank.tolist() == [0, 1, 2, 2, 3, 4] and tree.count.tolist() == [0, 6, 2, 6, 5, 1]
    place, rank = tree.before(tree.nodes_of(1))
    assert sorted(zip(tree.count[tree.nodes_of(1)][place].tolist(), rank.tolist())) == [(6, 1)]
