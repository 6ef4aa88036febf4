"""Finish small prefix classes depth-first, one task per class.

A prefix class is a frequent set with all its frequent extensions. Its weight, the number of
occurrences those extensions have together, is known exactly from the level that found them. Classes
up to ``CLASS_ROWS`` are shuffled by class and searched depth-first in one task; heavier ones stay in
the level loop, which splits them into lighter classes. So no group is larger than ``CLASS_ROWS``.

Inside a class a set is kept by the transactions that hold it or, where that is shorter, by what it loses against its prefix:
(place in the list of the prefix, loss of membership, whether the transaction is lost). A longer set's losses are those of its last
item beyond those of the item before, so they shrink with each item, and supports follow by subtraction. Binary floating-point
memberships stay with lists, as subtraction would round them.
"""

from __future__ import annotations

import sys
import time
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemweave.operators.dictionary import sum_type
from itemweave.plans.fptrees import spell
from itemweave.plans.levels import LevelRun
from itemweave.plans.storage import Workspace

# Send the helpers below with the job, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Most (transaction, item) rows one class may hold to be searched in one task.
CLASS_ROWS = 500_000


class ClassSearch:
    """Depth-first search of one class. ``sets`` are ``(path, support, freq)``; ``tested`` counts, by length of the path, the sets that
    occur at all and their occurrences."""

    def __init__(self, min_support, min_frequency: int, most: int | None):
        self.min_support, self.min_frequency, self.most = min_support, min_frequency, most
        self.sets: list[tuple[tuple[int, ...], object, int]] = []
        self.tested: dict[int, tuple[int, int]] = {}

    def _counted(self, path: tuple[int, ...], support, freq: int) -> bool:
        if freq:
            n, occurrences = self.tested.get(len(path), (0, 0))
            self.tested[len(path)] = (n + 1, occurrences + freq)
        if freq < self.min_frequency or not support >= self.min_support:
            return False
        self.sets.append((path, support, freq))
        return True

    def _goes_on(self, path: tuple[int, ...], found: list) -> bool:
        return len(found) > 1 and (self.most is None or len(path) + 1 < self.most)

    def lists(self, prefix: tuple[int, ...], members: list) -> None:
        """``members`` are (rank, transactions, memberships)."""
        for i, (rank, txns, ms) in enumerate(members):
            path, found = (*prefix, rank), []
            for other, other_txns, other_ms in members[i + 1:]:
                at = np.minimum(np.searchsorted(other_txns, txns), len(other_txns) - 1)
                hit = other_txns[at] == txns
                low = np.minimum(ms[hit], other_ms[at[hit]])
                if self._counted((*path, other), low.sum(), len(low)):
                    found.append((other, hit, low))
            if not self._goes_on(path, found):
                continue
            if ms.dtype.kind != "f":
                lost = [(other, *_loss(ms, hit, low), low.sum(), len(low)) for other, hit, low in found]
                if sum(len(places) for _, places, *_ in lost) < sum(len(low) for _, _, low in found):
                    self.losses(path, lost)
                    continue
            self.lists(path, [(other, txns[hit], low) for other, hit, low in found])

    def losses(self, prefix: tuple[int, ...], members: list) -> None:
        """``members`` are (rank, places, losses, whether lost, support, freq); the first three against the prefix."""
        for i, (rank, places, loss, _, support, freq) in enumerate(members):
            path, found = (*prefix, rank), []
            for other, other_places, other_loss, other_gone, _, _ in members[i + 1:]:
                more = other_loss.copy()
                if len(places):
                    at = np.minimum(np.searchsorted(places, other_places), len(places) - 1)
                    both = places[at] == other_places
                    more[both] -= loss[at[both]]
                keep = more > 0
                more, gone = more[keep], other_gone[keep]
                left, n = support - more.sum(), freq - int(gone.sum())
                if self._counted((*path, other), left, n):
                    found.append((other, other_places[keep], more, gone, left, n))
            if self._goes_on(path, found):
                self.losses(path, found)


def _loss(ms: np.ndarray, hit: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    loss = ms.copy()
    loss[hit] -= low
    places = np.flatnonzero(loss > 0)
    return places, loss[places], ~hit[places]


def mine_grouped(search, occ: DataFrame, min_support, support_for, min_frequency: int | None,
                 max_len: int | None, started: float):
    """The level loop with :func:`split` and :func:`finish` attached."""
    kind = sum_type(occ.schema["prob"].dataType)
    found: dict[int, list] = {}

    def split(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
        return classes.where(F.col("weight") > CLASS_ROWS), classes.where(F.col("weight") <= CLASS_ROWS)

    def finish(run: LevelRun, first: DataFrame, ws: Workspace) -> list[DataFrame]:
        names = first.select("rank", "item")
        out, began = [], time.time()
        for n, state in enumerate(run.local_states):
            length = n + 2  # states taken after level k hold the extensions of (k-1)-sets
            prefixes = run.tables[n + 1].select("pid", "items").groupBy("pid").agg(
                F.slice(F.first("items"), 1, length - 1).alias("prefix"))
            extra = None if max_len is None else max_len - length + 1

            def search_class(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
                sizes = pdf["r"].str.len().to_numpy()
                txn = np.repeat(np.arange(len(pdf)), sizes)
                rank, m = np.concatenate(pdf["r"].to_numpy()), np.concatenate(pdf["m"].to_numpy())
                order = np.lexsort((txn, rank))
                rank, txn, m = rank[order], txn[order], m[order]
                cuts = np.flatnonzero(np.diff(rank)) + 1
                starts = np.concatenate(([0], cuts))
                members = [(int(rank[s]), t, v) for s, t, v in zip(starts, np.split(txn, cuts), np.split(m, cuts))]
                # A float does not compare with decimal memberships.
                limit = Decimal(str(min_support)) if isinstance(m[0], Decimal) else min_support
                task = ClassSearch(limit, min_frequency or 1, extra)
                task.lists((), members)
                rows = [(key[0], list(p), s, f, len(p), 0) for p, s, f in task.sets]
                rows += [(key[0], None, m[0] * 0, f, k, n) for k, (n, f) in task.tested.items()]
                return pd.DataFrame(rows, columns=["pid", "path", "support", "freq", "extra", "tested"])

            sets = state.groupBy("sid").applyInPandas(
                search_class, f"pid bigint, path array<int>, support {kind}, freq bigint, extra int, tested bigint")
            sets = ws.write(sets.withColumn("sid2", F.monotonically_increasing_id()), f"classes-{length}")
            is_set = F.col("path").isNotNull()
            by_length = sets.groupBy("extra").agg(F.sum("tested"), F.count(F.when(is_set, 1)), F.sum(F.when(~is_set, F.col("freq"))))
            for more, *numbers in by_length.collect():  # a row for each length
                numbers += [0.0]
                k = length - 1 + more
                found[k] = [a + b for a, b in zip(found.get(k, [0, 0, 0, 0.0]), numbers)]
            full = (sets.where(is_set).join(spell(sets, names, "sid2", "path"), "sid2").join(prefixes, "pid")
                    .select(F.concat("prefix", "tail").alias("items"), "support", "freq"))
            out.append(full)
            # All lengths are found by one job, whose time goes to the shortest.
            found.setdefault(length + 1, [0, 0, 0, 0.0])[3] += time.time() - began
            began = time.time()
        return out

    # The threshold is a count by now, also where a proportion made it a fraction.
    result = search(occ, F.col("txn_id"), F.col("prob"), 0, lambda _: support_for(min_support), max_len, started,
                    split_local=split, finish_local=finish)
    loop = {s["k"]: s for s in result.stats}
    for k, (tested, frequent, occurrences, seconds) in sorted(found.items()):
        stat = loop.setdefault(k, {"k": k, "candidates": 0, "frequent": 0, "occurrences": 0, "seconds": 0.0})
        stat["candidates"] += tested
        stat["frequent"] += frequent
        stat["occurrences"] += occurrences
        stat["seconds"] = round(stat["seconds"] + seconds, 3)
    result.stats = [loop[k] for k in sorted(loop)]
    return result
