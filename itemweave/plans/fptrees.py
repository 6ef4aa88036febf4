"""FP-growth as Spark jobs: conditional transactions by groups of items, and a prefix tree for each group.

Items are ranked, frequent ones first, and a transaction is its ascending ranks. What a set with the last rank x needs to know of a
transaction is the part before x, so a group of neighbouring ranks needs one row of a transaction at most: the part up to the last of
its ranks. Groups are cut by measured cells (the ranks of all those parts), so that none holds more than twice ``GROUP_CELLS``; each
is put into a prefix tree and mined in one task. A single rank heavier than that is not given to a task: its parts become a
state of their own, with equal rows merged, and are cut into groups in the next round. Items, groups and sets stay in tables.
"""

from __future__ import annotations

import sys
import time

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemweave.plans.levels import broadcast_if, pack_units, rank_items, text_bytes
from itemweave.plans.storage import Workspace

# Send the helpers below with the job, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Ranks of all conditional transactions that a group is cut at (a task holds at most twice as many).
GROUP_CELLS = 4_000_000


class Tree:
    """A prefix tree in arrays: rank, parent and count of each node; node 0 is the root."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, n: np.ndarray):
        """Rows are stretches of ``flat`` of the given ``sizes``, ascending, each standing for ``n`` transactions."""
        begin = np.cumsum(sizes) - sizes
        at = np.zeros(len(sizes), np.int64)
        rank, parent, count = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        nodes, depth, alive = 1, 0, np.flatnonzero(sizes > 0)
        while len(alive):
            keys, place = np.unique((at[alive] << 32) | flat[begin[alive] + depth], return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, place, n[alive])
            rank.append(keys & 0xFFFFFFFF)
            parent.append(keys >> 32)
            count.append(total)
            at[alive] = nodes + place
            nodes += len(keys)
            depth += 1
            alive = alive[sizes[alive] > depth]
        self.rank, self.parent, self.count = np.concatenate(rank), np.concatenate(parent), np.concatenate(count)
        self.by_rank = np.argsort(self.rank, kind="stable")[1:]  # without the root, whose rank is 0
        self.ranks, self.starts = np.unique(self.rank[self.by_rank], return_index=True)

    def nodes_of(self, i: int) -> np.ndarray:
        end = self.starts[i + 1] if i + 1 < len(self.ranks) else len(self.by_rank)
        return self.by_rank[self.starts[i]:end]

    def before(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``nodes``, rank) of all nodes between each of them and the root."""
        who, up = np.arange(len(nodes)), self.parent[nodes]
        places, ranks = [], []
        while True:
            who, up = who[up > 0], up[up > 0]
            if not len(up):
                break
            places.append(who)
            ranks.append(self.rank[up])
            up = self.parent[up]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(ranks)


def grow_tree(tree: Tree, lowest: int, least: int, most: int | None, found: list, tested: dict) -> None:
    """Add ``(path, count)`` of all frequent sets of two or more whose last rank is ``lowest`` or more to ``found``, and how
    many sets of each length were counted, and their occurrences, to ``tested``."""
    work = [(tree, lowest, ())]
    while work:
        tree, lowest, tail = work.pop()
        for i in range(int(np.searchsorted(tree.ranks, lowest)), len(tree.ranks)):
            nodes = tree.nodes_of(i)
            path, n = (int(tree.ranks[i]), *tail), tree.count[nodes]
            place, rank = tree.before(nodes)
            if not len(rank) or n.sum() < least:
                continue
            seen, code = np.unique(rank, return_inverse=True)
            total = np.zeros(len(seen), np.int64)
            np.add.at(total, code, n[place])
            sets, occurrences = tested.get(len(path) + 1, (0, 0))
            tested[len(path) + 1] = (sets + len(seen), occurrences + int(total.sum()))
            good = total >= least
            found.extend(((int(r), *path), int(c)) for r, c in zip(seen[good], total[good]))
            if good.sum() > 1 and (most is None or len(path) + 2 <= most):
                kept = good[code]
                place, rank = place[kept], rank[kept]
                order = np.lexsort((rank, place))
                work.append((Tree(rank[order], np.bincount(place, minlength=len(nodes)), n), 0, path))


def _mine_group(least: int, most: int | None):
    def mine(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        paths = table["r"].combine_chunks()
        paths = paths.chunk(0) if isinstance(paths, pa.ChunkedArray) else paths
        sizes = np.diff(paths.offsets.to_numpy())
        flat = paths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        found, tested = [], {}
        grow_tree(Tree(flat, sizes, table["n"].to_numpy()), table["lo"][0].as_py(), least, most, found, tested)
        rows = [(p, len(p), c, 0) for p, c in found] + [(None, k, occurrences, n) for k, (n, occurrences) in tested.items()]
        path, length, freq, counted = zip(*rows) if rows else ((), (), (), ())
        return pa.table({"sid": pa.array([key[0].as_py()] * len(rows), pa.int64()), "path": pa.array(path, pa.list_(pa.int32())),
                         "length": pa.array(length, pa.int32()), "freq": pa.array(freq, pa.int64()),
                         "tested": pa.array(counted, pa.int64())})
    return mine


def spell(sets: DataFrame, names: DataFrame, key: str, path: str) -> DataFrame:
    """``(key, tail)``: the item names of each row's ranks, by the table ``names`` of (rank, item)."""
    return (sets.select(key, F.explode(path).alias("rank")).join(names, "rank")
            .groupBy(key).agg(F.collect_list("item").alias("tail")))


def mine_trees(occ: DataFrame, least: int, max_len: int | None) -> tuple[list[DataFrame], list[dict], Workspace]:
    """Tables of frequent sets ``(items, freq)``, statistics of each level, and the folder that holds them."""
    ws, began = Workspace(occ.sparkSession), time.time()
    cached = occ.persist()
    try:
        items = ws.write(cached.groupBy("item").agg(F.count(F.lit(1)).alias("freq")), "items")
        first = items.where(F.col("freq") >= least)
        n_items, item_text = first.agg(F.count(F.lit(1)), text_bytes(F.col("item"))).first()
        first = ws.write(rank_items(first, n_items, [F.col("freq").desc(), F.col("item")], ws).select("item", "rank"), "ranks")
        names = broadcast_if(first, n_items, item_text)
        packed = pack_units(cached.join(names, "item").select(F.col("txn_id").alias("unit"), "rank"), False, shortest=1)
        state = ws.write(packed.groupBy("sid", "r").agg(F.count(F.lit(1)).alias("n")), "state-1")
    finally:
        cached.unpersist()
    prefixes = state.sparkSession.range(1).select(F.col("id").alias("sid"), F.array().cast("array<string>").alias("prefix"))
    n_parts = int(occ.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out, stats, k, n_prefixes, text = [], {}, 1, 1, 0

    def add(length: int, candidates: int, frequent: int, occurrences: int, seconds: float) -> None:
        old = stats.get(length, (0, 0, 0, 0.0))
        stats[length] = tuple(a + b for a, b in zip(old, (candidates, frequent, occurrences, seconds)))

    add(1, *items.agg(F.count(F.lit(1)), F.lit(0), F.coalesce(F.sum("freq"), F.lit(0))).first(), 0.0)
    while True:
        counted = (state.select("sid", "n", F.posexplode("r").alias("pos", "rank")).groupBy("sid", "rank")
                   .agg(F.sum("n").alias("freq"), F.sum(F.col("pos") + 1).alias("cells")))
        counted = ws.write(counted.withColumn("id", F.monotonically_increasing_id()), f"counted-{k}")
        sets = counted.where(F.col("freq") >= least)
        level = ws.write(sets.join(names, "rank").join(broadcast_if(prefixes, n_prefixes, text), "sid")
                         .select("id", "sid", "rank", "freq", "cells", F.array_append("prefix", F.col("item")).alias("items")), f"sets-{k}")
        n_sets, level_text, heavy = level.agg(F.count(F.lit(1)), text_bytes(F.array_join("items", ",")),
                                              F.count(F.when(F.col("cells") > GROUP_CELLS, 1))).first()
        seen = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("freq"), F.lit(0))).first() if k > 1 else (0, 0)
        add(k, seen[0], n_sets, seen[1], time.time() - began)
        if not n_sets:
            break
        out.append(level.select("items", "freq"))
        if max_len is not None and k >= max_len:
            break
        began = time.time()
        big = F.col("cells") > GROUP_CELLS
        along = Window.partitionBy("sid").orderBy("rank")
        # A heavy rank stands alone, and the groups on both of its sides are different ones.
        groups = level.withColumns({
            "turn": F.sum(F.when(big, 1).otherwise(0)).over(along),
            "run": F.sum(F.when(big, 0).otherwise(F.col("cells"))).over(along) - F.when(big, 0).otherwise(F.col("cells"))})
        groups = groups.withColumn("grp", F.concat_ws("-", "turn", F.floor(F.col("run") / F.lit(GROUP_CELLS)))).where(~big)
        each = Window.partitionBy("sid", "grp")
        groups = ws.write(groups.select("sid", "rank", "grp", F.min("rank").over(each).alias("lo"),
                                        F.max("rank").over(each).alias("last")), f"groups-{k}")
        if k > 1:  # ranks that are not frequent below their prefix
            kept = level.groupBy("sid").agg(F.collect_list("rank").alias("ext"))
            state = state.join(broadcast_if(kept, n_sets), "sid").withColumn("r", F.array_intersect("r", "ext")).drop("ext")
        heads = (state.where(F.size("r") > 1).withColumn("j", F.explode(F.sequence(F.lit(1), F.size("r") - 1)))
                 .withColumn("rank", F.get("r", F.col("j"))))
        after = F.get("r", F.col("j") + 1)
        parts = (heads.join(broadcast_if(groups, n_sets), ["sid", "rank"]).where(after.isNull() | (after > F.col("last")))
                 .select("sid", "grp", "lo", F.slice("r", F.lit(1), F.col("j") + 1).alias("r"), "n"))
        most = None if max_len is None else max_len - k + 1
        mined = (parts.repartition(n_parts, "sid", "grp").groupBy("sid", "grp")
                 .applyInArrow(_mine_group(least, most), "sid bigint, path array<int>, length int, freq bigint, tested bigint"))
        mined = ws.write(mined.withColumn("set", F.monotonically_increasing_id()), f"mined-{k}")
        is_set = F.col("path").isNotNull()
        by_length = mined.groupBy("length").agg(F.sum("tested"), F.count(F.when(is_set, 1)), F.coalesce(F.sum(F.when(~is_set, F.col("freq"))), F.lit(0)))
        for length, *numbers in by_length.collect():  # a row for each length
            add(length + k - 1, *numbers, 0.0)
        out.append(mined.where(is_set).join(spell(mined, names, "set", "path"), "set")
                   .join(broadcast_if(prefixes, n_prefixes, text), "sid").select(F.concat("prefix", "tail").alias("items"), "freq"))
        add(k + 1, 0, 0, 0, time.time() - began)  # all lengths are found by one job
        if not heavy:
            break
        began = time.time()
        large = level.where(big).select("sid", "rank", F.col("id").alias("next"), "items")
        state = (heads.join(broadcast_if(large.drop("items"), heavy), ["sid", "rank"])
                 .select(F.col("next").alias("sid"), F.slice("r", F.lit(1), F.col("j")).alias("r"), "n")
                 .groupBy("sid", "r").agg(F.sum("n").alias("n")))
        k += 1
        state = ws.write(state, f"state-{k}")
        prefixes, n_prefixes = large.select(F.col("next").alias("sid"), F.col("items").alias("prefix")), heavy
        text = level_text
    rows = [{"k": k, "candidates": c, "frequent": n, "occurrences": o, "seconds": round(s, 3)}
            for k, (c, n, o, s) in sorted(stats.items()) if c]
    ws.drop("items", *[f"state-{i}" for i in range(1, k + 1)], *[f"counted-{i}" for i in range(1, k + 1)],
            *[f"groups-{i}" for i in range(1, k + 1)])
    return out, rows, ws
