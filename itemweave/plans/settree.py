"""Support of many given sets by a prefix tree that is walked along packed transactions.

Sets are coded as ascending ranks and sorted, so that those with a common beginning are neighbours, and cut into parts of at most
``PART_ITEMS`` ranks. Each part becomes a tree in sorted arrays: a child is found by the key (parent, rank), so sets with a common
beginning cost one path. A task walks a batch of transactions at once: the frontier holds (transaction, node, place) and moves on by
looking up either the later items of the transaction among the children or the children among the items, whichever is less. Nothing
is copied per item; a task adds up its own counts and sends one row for each set that it met.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Send the helpers below with the job, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Ranks of the sets whose tree a task holds (some 100 MB with its counts).
PART_ITEMS = 4_000_000
#: Lookups that are laid out at a time.
LOOKUPS = 1 << 21


class Tree:
    """Keys (parent, rank) of all nodes but the root in ascending order; node k has the k-th key, counted from 1."""

    def __init__(self, ids: np.ndarray, ranks: list[np.ndarray]):
        """``ids`` of the sets; their ascending ``ranks``, sorted by ranks, all different."""
        sizes = np.array([len(r) for r in ranks], np.int64)
        flat = np.concatenate(ranks).astype(np.int64) if len(ranks) else np.zeros(0, np.int64)
        begin = np.cumsum(sizes) - sizes
        parent, keys, nodes = np.zeros(len(ids), np.int64), [], 0
        self.set_of = [np.full(1, -1, np.int64)]
        alive, depth = np.flatnonzero(sizes > 0), 0
        while len(alive):
            key = (parent[alive] << 32) | flat[begin[alive] + depth]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            node = nodes + np.cumsum(first)
            parent[alive] = node
            keys.append(key[first])
            nodes += int(first.sum())
            depth += 1
            ends = np.full(int(first.sum()), -1, np.int64)
            done = sizes[alive] == depth
            ends[node[done] - node[0]] = ids[alive[done]]
            self.set_of.append(ends)
            alive = alive[~done]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.set_of = np.concatenate(self.set_of)
        # Children of node k are the nodes first[k] + 1 .. first[k + 1].
        self.first = np.searchsorted(self.keys, np.arange(nodes + 2, dtype=np.int64) << 32)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of so many: whose it is, and its place there."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def walk(tree: Tree, sizes: np.ndarray, ranks: np.ndarray, values: np.ndarray | None, freq: np.ndarray, support: np.ndarray | None) -> None:
    """Add the transactions (``sizes``, and all ``ranks`` in turn) to the counts of the nodes they reach."""
    ends = np.cumsum(sizes)
    which = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    keyed = (which << 32) | ranks  # ascending, so an item is found in its transaction
    begin = ends - sizes
    frontier = [(np.arange(len(sizes)), np.zeros(len(sizes), np.int64), begin, None)]
    while frontier:
        txn, node, at, low = frontier.pop()
        items, children = ends[txn] - at, tree.first[node + 1] - tree.first[node]
        cost = np.minimum(items, children)
        if cost.sum() > LOOKUPS and len(txn) > 1:
            half = len(txn) // 2
            for cut in (slice(half, None), slice(0, half)):
                frontier.append((txn[cut], node[cut], at[cut], None if low is None else low[cut]))
            continue
        by_item = items <= children
        # The later items of a transaction, looked up among a node's children.
        rows = np.flatnonzero(by_item)
        owner, place = _spread(items[rows])
        owner = rows[owner]
        where = at[owner] + place
        key = (node[owner] << 32) | ranks[where]
        child = np.minimum(np.searchsorted(tree.keys, key), max(len(tree.keys) - 1, 0))
        hit = tree.keys[child] == key if len(tree.keys) else np.zeros(len(key), bool)
        met = [(owner[hit], child[hit] + 1, where[hit])]
        # A node's children, looked up among the items.
        rows = np.flatnonzero(~by_item)
        owner, place = _spread(children[rows])
        owner = rows[owner]
        child = tree.first[node[owner]] + place
        key = (txn[owner] << 32) | (tree.keys[child] & 0xFFFFFFFF)
        where = np.minimum(np.searchsorted(keyed, key), len(keyed) - 1)
        hit = keyed[where] == key
        met.append((owner[hit], child[hit] + 1, where[hit]))
        owner, child, where = (np.concatenate(c) for c in zip(*met, strict=True))
        if not len(owner):
            continue
        np.add.at(freq, child, 1)
        if values is not None:
            new = values[where] if low is None else np.minimum(low[owner], values[where])
            np.add.at(support, child, new)
        else:
            new = None
        on = tree.first[child + 1] > tree.first[child]
        if on.any():
            frontier.append((txn[owner][on], child[on], where[on] + 1, None if new is None else new[on]))


def _count(tree, schema: pa.Schema, fuzzy: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Tree = tree.value
        freq, support = np.zeros(len(own.set_of), np.int64), None
        for batch in batches:
            lists = batch.column(0)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False) if fuzzy else None
            if fuzzy and support is None:
                support = np.zeros(len(freq), values.dtype if values.dtype != object else object)
            if sizes.sum():
                walk(own, sizes, lists.flatten().to_numpy().astype(np.int64), values, freq, support)
        met = np.flatnonzero((freq > 0) & (own.set_of >= 0))
        columns = [own.set_of[met], freq[met] if support is None else support[met], freq[met]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
    return run


def tree_support(units: DataFrame, coded: DataFrame, n_items: int, fuzzy: bool, kind: str) -> DataFrame:
    """(sid, support, freq) of the sets that occur.

    ``units`` are packed transactions ``(r[, m])``; ``coded`` has ``sid``, dense from 0 in the order of ``ranks``, and the
    ascending ``ranks``; ``n_items`` is how many ranks they have together; ``kind`` the type of a support.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    spark = units.sparkSession
    schema = pa.schema([("sid", pa.int64()), ("support", to_arrow_type(_parse_datatype_string(kind))), ("freq", pa.int64())])
    parts = -(-n_items // PART_ITEMS)
    n_sets = coded.count()
    step = max(-(-n_sets // max(parts, 1)), 1)
    lists = units.select("r", "m") if fuzzy else units.select("r")
    found = None
    for lo in range(0, max(n_sets, 1), step):
        rows = coded.where((F.col("sid") >= lo) & (F.col("sid") < lo + step)).select("sid", "ranks").toArrow().sort_by("sid")
        tree = spark.sparkContext.broadcast(Tree(rows.column("sid").to_numpy(), [r.values.to_numpy() for r in rows.column("ranks")]))
        part = lists.mapInArrow(_count(tree, schema, fuzzy), f"sid long, support {kind}, freq long")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("sid").agg(F.sum("support").cast(kind).alias("support"), F.sum("freq").alias("freq"))
