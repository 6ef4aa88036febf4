"""Questions from blocks of documents to tables of the whole corpus, and back.

Documents are dealt into blocks of bounded size. A block sends each distinct question (a hash) once; questions are brought
together by hash, and the answers go back to the blocks that asked. A question that every document asks costs one row a
block, and nothing that grows with the corpus is broadcast or held by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES, CHUNK_BYTES = 24 << 20, 2 << 20


class Blocks:
    """The columns doc_id and text of ``docs``, dealt by a hash of both into blocks of about ``block_bytes / finer``.

    ``meet`` takes a row for each question. ``merge`` takes runs instead: a block sends its questions sorted, one row of
    packed arrays for each of ``ranges`` equal ranges of the hash, and a range's runs meet in one call of bounded size.
    """

    def __init__(self, docs: DataFrame, doc_id: str, text: str, block_bytes: int = BLOCK_BYTES, *, finer: int = 1):
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.count = int(size * finer // block_bytes) + 1
        self.ranges = self.count // 2 + 1
        self.parts = max(self.count, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        self.rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.count)).cast("int"))

    def ask(self, fn: Callable, schema: str) -> DataFrame:
        return self.rows.groupBy("block").applyInArrow(fn, schema)

    def tell(self, answers: DataFrame, fn: Callable, schema: str) -> DataFrame:
        """``fn(docs, answers)`` by block; a block without answers gets an empty table."""
        return self.rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(fn, schema)

    def meet(self, questions: DataFrame, fn: Callable, schema: str, *order: str) -> DataFrame:
        """Bring rows with the same ``key`` together, sorted; ``fn`` gets tables of whole groups."""
        dealt = questions.repartition(self.parts, "key").sortWithinPartitions("key", *order)
        return dealt.mapInArrow(whole_groups(fn), schema)

    def merge(self, runs: DataFrame, fn: Callable, schema: str) -> DataFrame:
        """``fn`` on all runs of a range of the hash."""
        return runs.groupBy("range").applyInArrow(fn, schema)


def to_runs(block: int, ranges: int, key: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """The rows of a block, sorted by ``key`` (evenly spread 64-bit hashes), as one row of arrays for each range that has any."""
    bounds = np.arange(1, ranges, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // ranges)
    cuts = np.concatenate([[0], np.searchsorted(key, bounds), [len(key)]])
    own = np.flatnonzero(cuts[1:] > cuts[:-1])
    spans = list(zip(cuts[own].tolist(), cuts[own + 1].tolist(), strict=True))
    packed = {n: pa.array([v[a:b].tobytes() for a, b in spans], pa.binary()) for n, v in {"key": key, **columns}.items()}
    return pa.table({"range": pa.array(own, pa.int32()), "block": pa.array(np.full(len(own), block), pa.int32()), **packed})


def unpacked(runs: pa.Table, column: str, dtype: type) -> np.ndarray:
    """The arrays of a column, one after another."""
    return np.frombuffer(b"".join(runs.column(column).to_pylist()), dtype)


def select_runs(runs: pa.Table, keep: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """Rows of runs as packed arrays by block; ``keep`` and the columns go by the runs' rows, one run after another."""
    sizes = [len(k) // 8 for k in runs.column("key").to_pylist()]
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    own = [(r, np.flatnonzero(keep[a:b]) + a) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    own = [(r, at) for r, at in own if len(at)]
    blocks = runs.column("block").to_numpy()
    packed = {n: pa.array([v[at].tobytes() for _, at in own], pa.binary()) for n, v in columns.items()}
    return pa.table({"block": pa.array([blocks[r] for r, _ in own], pa.int32()), **packed})


def whole_groups(fn: Callable[[pa.Table], pa.Table], rows: int = 50_000) -> Callable:
    """For mapInArrow over rows sorted by the column ``key``: call ``fn`` on runs of rows that split no key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            key = batch.column("key").to_numpy()
            if not len(key):
                continue
            # The batch's last key may go on; all before it is complete.
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if not cut and held and held[-1].column("key")[len(held[-1]) - 1].as_py() != key[0]:
                yield from fn(pa.Table.from_batches(held)).to_batches()
                held, size = [], 0
            held.append(batch.slice(0, cut) if cut else batch)
            size += len(held[-1])
            if cut:
                if size >= rows:
                    yield from fn(pa.Table.from_batches(held)).to_batches()
                    held, size = [], 0
                held.append(batch.slice(cut))
                size += len(batch) - cut
        if held:
            yield from fn(pa.Table.from_batches(held)).to_batches()
    return run


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> list[tuple[int, int]]:
    """Row ranges whose sizes add up to about ``limit``; a larger row is alone at the end of its range."""
    cuts, at = [0], 0
    for i, s in enumerate(sizes):
        at += s
        if at >= limit:
            cuts.append(i + 1)
            at = 0
    return [(a, b) for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True) if a < b]


def starts(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def contained(sorted_keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys occur in a sorted array."""
    if not len(sorted_keys):
        return np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)
    return sorted_keys[at] == key


def sliding(x: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """The least (or ``best``) of each ``width`` consecutive values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out, have = best(out[:len(out) - step], out[step:]), have + step
    return out


def sampled(gram: np.ndarray, low: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """The places whose gram is the least of some valid window of ``width`` grams; low: the least gram of each window."""
    masked = np.where(valid, low, low.dtype.type(0))
    pad = np.zeros(width - 1, low.dtype)
    reach = sliding(np.concatenate([pad, masked, pad]), width, np.maximum)[:len(gram)]
    return np.flatnonzero((gram == reach) & (reach > 0))
