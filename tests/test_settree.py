"""Support of given sets by the prefix tree, against a direct count."""

import random
import time
from decimal import Decimal

import numpy as np
import pytest

from itemweave.operators.candidates import count_support
from itemweave.plans import settree


def direct(rows, sets, fuzzy):
    held = {}
    for t, i, m in rows:
        if not fuzzy or m > 0:
            held.setdefault(t, {})[i] = max(m, held.get(t, {}).get(i, 0))
    out = {}
    for s in sets:
        key = tuple(sorted(set(s)))
        met = [min(h[i] for i in key) for h in held.values() if key and all(i in h for i in key)]
        out[key] = (sum(met) if fuzzy else len(met), len(met))
    return out


@pytest.mark.parametrize("part_items", [7, 4_000_000])
@pytest.mark.parametrize("kind", ["bigint", "double", "decimal(5,2)", None])
def test_given_sets(spark, monkeypatch, kind, part_items):
    monkeypatch.setattr(settree, "PART_ITEMS", part_items)
    monkeypatch.setattr(settree, "LOOKUPS", 50)
    rng = random.Random(21)
    cast = {"double": lambda m: m / 4, "decimal(5,2)": lambda m: Decimal(m) / 4}.get(kind, int)
    rows = [(t, f"i{i}", cast(rng.randint(0, 9))) for t in range(60) for i in range(12) if rng.random() < 0.5]
    rows += [(100, f"i{i}", cast(1)) for i in range(12)] + rows[:20]
    sets = [rng.sample([f"i{i}" for i in range(13)], rng.randint(1, 6)) for _ in range(25)]
    sets += [["i1", "i1"], [], ["i3"], ["i3", "i4"], ["i3", "i4", "i5"], ["none"], sets[0]]
    df = spark.createDataFrame(rows, f"txn_id bigint, item string, prob {kind or 'int'}").repartition(3)
    asked = spark.createDataFrame([(s,) for s in sets], "items array<string>")
    got = {tuple(r["items"]): (r["support"], r["freq"]) for r in count_support(df, asked, fuzzy=kind is not None).collect()}
    assert got == direct(rows, sets, kind is not None)


def test_no_sets_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a", 2)], "txn_id bigint, item string, prob bigint")
    asked = spark.createDataFrame([(["a"],)], "items array<string>")
    assert count_support(df, asked.limit(0)).count() == 0
    assert [tuple(r) for r in count_support(df.limit(0), asked, fuzzy=True).collect()] == [(["a"], 1, 0, 0)]


def test_common_beginnings_cost_one_path():
    """Ten times the sets below one rare beginning take no longer for transactions that do not reach it."""
    rng = np.random.default_rng(1)
    sizes = np.full(4_000, 20)
    ranks = np.concatenate([np.sort(rng.choice(np.arange(5, 200), 20, replace=False)) for _ in sizes])

    def seconds(n):
        sets = sorted({(1, 2, *sorted(rng.choice(np.arange(3, 400), 3, replace=False).tolist())) for _ in range(n)})
        tree = settree.Tree(np.arange(len(sets)), [np.array(s) for s in sets])
        best = []
        for _ in range(5):
            freq, started = np.zeros(len(tree.set_of), np.int64), time.perf_counter()
            settree.walk(tree, sizes, ranks, None, freq, None)
            best.append(time.perf_counter() - started)
        return min(best)

    assert seconds(20_000) < 3 * seconds(2_000) + 0.02
