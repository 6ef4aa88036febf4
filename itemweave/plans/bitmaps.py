"""Compressed bitmaps: counting whole transactions of many sets by words of 64 bits, whatever the ids look like.

Transactions are sorted by ranges of their id and numbered as they come, so ids with holes leave no holes in the bitmaps. Each run of
``RANGE`` transactions is one row: for every frequent item in it a container, which is a list of 16-bit positions where the item is
rare and ``RANGE`` bits where it is common, whichever is smaller. The state of a level has the same form, one row per run and
frequent prefix, with the containers of prefix and item. Counting a level intersects containers inside the row and sends partial sums,
at most one row per candidate and task; the next state intersects those pairs again that were frequent. Rows never move after packing.

The frequent pairs that a task needs come as sorted arrays of at most ``SETS_PER_PASS`` sets; more sets are taken in so many passes over
the state, each with its own range of prefixes, so their size is bounded at any number of sets. From the third level on, pairs of items
that are not frequent by themselves are not counted: a triangular table holds one bit for each pair of ranks, again in ranges.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemweave.plans.levels import HEADS_PER_ROW, Steps

# Send the helpers below with the job, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Transactions behind one row, and entries (items of transactions) that end a row early.
RANGE, ENTRIES = 4_096, 1 << 22
#: Most positions that are kept as a list: beyond, bits are smaller.
LISTED = RANGE // 16
#: Frequent sets whose arrays a task holds at a time (40 MB).
SETS_PER_PASS = 2_000_000
#: Bits of the pair table that a task holds at a time (32 MB).
PAIR_BITS = 1 << 28
#: Candidates that a task adds up before it sends them.
PARTIAL = 1 << 19

_STATE = "sid long, r array<int>, n array<int>, listed binary, bits binary, lo int"
_SCHEMA = pa.schema([("sid", pa.int64()), ("r", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("listed", pa.binary()),
                     ("bits", pa.binary()), ("lo", pa.int32())])
_TOTALS = "sid long, a int, b int, m long"
_WORDS = RANGE // 64


def packed(words: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Containers as bytes: the positions of all listed ones in turn, and the bits of all others in turn."""
    rare = counts <= LISTED
    where = np.nonzero(np.unpackbits(words[rare].view(np.uint8), axis=1, bitorder="little"))[1]
    return where.astype(np.uint16).tobytes(), words[~rare].tobytes()


def unpacked(counts: np.ndarray, listed: bytes, bits: bytes) -> np.ndarray:
    """One row of ``RANGE`` bits, as words, for each container."""
    words = np.zeros((len(counts), _WORDS), np.uint64)
    rare = counts <= LISTED
    words[~rare] = np.frombuffer(bits, np.uint64).reshape(-1, _WORDS)
    where = np.frombuffer(listed, np.uint16)
    row = np.repeat(np.flatnonzero(rare), counts[rare])
    np.bitwise_or.at(words, (row, where >> 6), np.uint64(1) << (where & 63).astype(np.uint64))
    return words


def _row(sid: int, ranks: np.ndarray, words: np.ndarray, counts: np.ndarray, lo: int = 0) -> tuple:
    return (sid, ranks.astype(np.int32), counts.astype(np.int32), *packed(words, counts), lo)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(sid, ranks, counts, words, first head) of each row of a state."""
    for batch in batches:
        for i in range(len(batch)):
            sid, r, n, listed, bits, lo = (batch.column(c)[i] for c in range(6))
            counts = n.values.to_numpy()
            yield sid.as_py(), r.values.to_numpy(), counts, unpacked(counts, listed.as_py(), bits.as_py()), lo.as_py()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, rank), sorted, to one row per run of transactions."""
    def row(rank: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        ranks, index = np.unique(rank, return_inverse=True)
        words = np.zeros((len(ranks), _WORDS), np.uint64)
        np.bitwise_or.at(words, (index, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        return _batch([_row(0, ranks, words, np.bitwise_count(words).sum(axis=1, dtype=np.int64))])

    ranks: list[np.ndarray] = []
    places: list[np.ndarray] = []
    last, at, held = None, -1, 0
    for batch in batches:
        unit, rank = batch.column(0), batch.column(1).to_numpy()
        if not len(rank):
            continue
        new = np.ones(len(rank), bool)
        codes = unit.dictionary_encode().indices.to_numpy()
        new[1:] = codes[1:] != codes[:-1]
        new[0] = unit[0].as_py() != last
        last = unit[len(unit) - 1].as_py()
        place = at + np.cumsum(new)
        while len(rank):
            # A run ends with the transaction that fills it, or before the one that would make it too long.
            inside = np.searchsorted(place, RANGE)
            if held + inside > ENTRIES and place[0] > 0 and new.any():
                inside = min(inside, int(np.flatnonzero(new)[0]))
            ranks.append(rank[:inside])
            places.append(place[:inside])
            held += inside
            if inside == len(rank):
                at = int(place[-1])
                break
            yield row(np.concatenate(ranks), np.concatenate(places))
            ranks, places, held = [], [], 0
            rank, new, place = rank[inside:], new[inside:], place[inside:] - place[inside]
    if held:
        yield row(np.concatenate(ranks), np.concatenate(places))


def _allowed(table: tuple | None, head: int, others: np.ndarray) -> np.ndarray:
    """Which pairs (head, other) have their bit in the part of the pair table that is here."""
    if table is None:
        return np.ones(len(others), bool)
    lo, width, bits = table
    at = (head - lo) * width + (others >> 3)
    return (bits[at] >> (others & 7).astype(np.uint8)) & 1 == 1


def _count(pairs, heads_per_row: int):
    """Partial sums (sid, a, b, transactions) of the candidates in a state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        size = 0
        table = pairs.value if pairs is not None else None

        def sums() -> pa.RecordBatch:
            sid, a, b, m = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((b, a, sid))
            sid, a, b, m = sid[order], a[order], b[order], m[order]
            first = np.flatnonzero(np.concatenate([[True], (sid[1:] != sid[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            return pa.RecordBatch.from_arrays([pa.array(sid[first]), pa.array(a[first], pa.int32()), pa.array(b[first], pa.int32()),
                                               pa.array(np.add.reduceat(m, first))], names=["sid", "a", "b", "m"])

        for sid, r, _, words, lo in _rows(batches):
            for i in range(lo, min(len(r) - 1, lo + heads_per_row)):
                if table is not None and not table[0] <= r[i] < table[0] + len(table[2]) // table[1]:
                    continue  # another pass has this head
                later = np.flatnonzero(_allowed(table, int(r[i]), r[i + 1:])) + i + 1 if table is not None else np.arange(i + 1, len(r))
                n = np.bitwise_count(words[later] & words[i]).sum(axis=1, dtype=np.int64)
                hit = n > 0
                if hit.any():
                    b = r[later][hit]
                    found.append((np.full(len(b), sid), np.full(len(b), r[i]), b, n[hit]))
                    size += len(b)
                if size >= PARTIAL:
                    yield sums()
                    found, size = [], 0
        if found:
            yield sums()
    return run


def _advance(sets):
    """The next state: for each prefix and frequent head, the later items that are frequent with both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid_all, a_all, b_all, pid_all = sets.value
        out: list[tuple] = []
        for sid, r, _, words, lo in _rows(batches):
            if lo:  # rows that are spread by head come back as one
                continue
            begin, end = np.searchsorted(sid_all, [sid, sid + 1])
            if begin == end:
                continue
            a, b, pid = a_all[begin:end], b_all[begin:end], pid_all[begin:end]
            i, j = np.searchsorted(r, a), np.searchsorted(r, b)
            here = (i < len(r)) & (j < len(r))
            here[here] = (r[i[here]] == a[here]) & (r[j[here]] == b[here])
            if not here.any():  # frequent pairs, but none of this run
                continue
            i, j, pid = i[here], j[here], pid[here]
            cuts = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1]]))
            for s, e in zip(cuts, np.append(cuts[1:], len(pid)), strict=True):
                if e - s < 2:
                    continue
                both = words[j[s:e]] & words[i[s]]
                counts = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
                some = counts > 0
                if some.sum() > 1:
                    out.append(_row(int(pid[s]), r[j[s:e]][some], both[some], counts[some]))
            if len(out) >= 256:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)
    return run


class BitmapSteps(Steps):
    """The steps of the level loop on compressed bitmaps."""

    def __init__(self):
        self.pairs: list = [None]

    def pack(self, rows: DataFrame) -> DataFrame:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        laid = rows.select("unit", "rank").repartitionByRange(parts, "unit").sortWithinPartitions("unit", "rank")
        return laid.mapInArrow(_pack, _STATE)

    def totals(self, state: DataFrame, widest: int) -> DataFrame:
        if widest > HEADS_PER_ROW:  # a row with many items is counted by several tasks
            parts = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            state = state.withColumn("lo", F.explode(F.sequence(F.lit(0), F.greatest(F.size("r") - 2, F.lit(0)), F.lit(HEADS_PER_ROW)))).repartition(parts)
        parts = [state.mapInArrow(_count(p, HEADS_PER_ROW if widest > HEADS_PER_ROW else widest), _TOTALS) for p in self.pairs]
        sums = parts[0]
        for more in parts[1:]:
            sums = sums.unionByName(more)
        total = F.sum("m")
        return sums.groupBy("sid", "a", "b").agg(total.alias("support"), total.alias("freq"))

    def advance(self, state: DataFrame, level: DataFrame, n_sets: int, n_items: int, k: int) -> DataFrame:
        spark = state.sparkSession
        out = None
        for sets in self._passes(level, n_sets):
            part = state.mapInArrow(_advance(spark.sparkContext.broadcast(sets)), _STATE)
            out = part if out is None else out.unionByName(part)
        if k == 2:
            self.pairs = [spark.sparkContext.broadcast(p) for p in pair_tables(level, n_items)]
        return out

    def _passes(self, level: DataFrame, n_sets: int) -> Iterator[tuple[np.ndarray, ...]]:
        """The frequent sets of a level as arrays sorted by (sid, a, b), at most about ``SETS_PER_PASS`` at a time.

        A pass takes the classes (sid, a) of some hash values, so that a class is whole and a prefix may be in several passes.
        """
        passes = -(-n_sets // SETS_PER_PASS)
        slot = F.pmod(F.xxhash64("sid", "a"), F.lit(passes))
        for p in range(passes):
            rows = level.where(slot == p).select("sid", "a", "b", "pid").toArrow()
            sid, a, b, pid = (rows.column(c).to_numpy() for c in ("sid", "a", "b", "pid"))
            order = np.lexsort((b, a, sid))
            yield sid[order], a[order], b[order], pid[order]


def pair_tables(level: DataFrame, n_items: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """One bit for each frequent pair of ranks: (first head, bytes per head, bits) for ranges of heads of at most ``PAIR_BITS``.

    Words are put together with ``bit_or`` before they travel, so a range costs its bits however many pairs it holds.
    """
    width = (n_items >> 3) + 1
    width += -width % 8
    heads = max(PAIR_BITS // (8 * width), 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b").bitwiseAND(F.lit(63)))
    words = level.groupBy("a", F.shiftright("b", 6).alias("w")).agg(F.bit_or(bit).alias("bits"))
    for lo in range(1, n_items + 1, heads):
        here = min(heads, n_items + 1 - lo)
        found = words.where((F.col("a") >= lo) & (F.col("a") < lo + here)).toArrow()
        table = np.zeros(here * width // 8, np.int64)
        at = (found.column("a").to_numpy().astype(np.int64) - lo) * (width // 8) + found.column("w").to_numpy()
        table[at] = found.column("bits").to_numpy()
        yield lo, width, table.view(np.uint8)


def sizes(state: DataFrame) -> DataFrame:
    """Containers, their transactions and bytes, by kind."""
    one = state.select(F.explode("n").alias("n")).withColumn("kind", F.when(F.col("n") <= LISTED, "list").otherwise("bits"))
    size = F.when(F.col("kind") == "list", 2 * F.col("n")).otherwise(RANGE // 8)
    return one.groupBy("kind").agg(F.count("*").alias("containers"), F.sum("n").cast("bigint").alias("transactions"), F.sum(size).cast("bigint").alias("bytes"))
