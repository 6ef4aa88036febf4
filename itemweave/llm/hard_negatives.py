"""Hard negatives: for an anchor and each of its best positives, the rows of other labels that score almost as high.

Vectors become whole numbers, floor(scale * x), so scores are exact. Each vector is stored with the summaries of its segments: at 1, 4,
16 and 32 segments, the sum of a segment over the root of its length (its mean, weighed by length) and the root of its squared
deviations from the mean. For two vectors, a segment's part of the product is mean * mean, give or take deviation * deviation, so that the sums
over segments bound the score from both sides. A search starts from the bounds of whole vectors; the exact scores of the few rows with
the best middles say what the others have to reach. Rows that cannot be among the best, or in the window of scores asked for, drop
out, the finer segments go on with the rest, and what passes all levels is scored exactly. Bounds of a slice are matrix products.

Anchors meet all rows in blocks: rows are dealt by a hash of their id into slices of at most ``SLICE_ROWS``, anchors into sets of at
most ``ANCHOR_ROWS``, and a task gets one slice and one set, each of bounded size. It returns the best few of the slice for each
anchor; of these the best are taken by rank. Nothing is broadcast or collected, and no row is left out: a label, or copies of one vector,
may hold any share of the rows.

Defined cases: rows with a NULL id, label or vector, or with a NULL or non-finite component, or one beyond the doubles when scaled,
take no part; of several rows with one id the least by label, then vector counts; vectors of different lengths meet as if filled up with
zeros, an empty one scores 0; ties go by the smaller id; fewer rows than asked for give as many as there are; empty tables give an empty
result; further columns do not matter. Scores are exact whole numbers; one beyond the longs is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemweave.llm.common import Scratch

SLICE_ROWS, ANCHOR_ROWS = 32_768, 4_096
#: Segments of a vector at each level of refinement.
LEVELS = (1, 4, 16, 32)
#: Products of components below this bound sum exactly in doubles for up to 2^13 components.
EXACT = 2.0 ** 20
#: Bounds are widened by this share of the norms, more than rounding to floats can be wrong by.
SLACK = 1e-5
#: Rows whose exact scores set the first thresholds; pairs of a row and an anchor bounded at a time.
PROBES, PAIRS = 32, 1 << 21


def summary(x: np.ndarray) -> np.ndarray:
    """For each row of ``x`` the weighed means of all segments at all levels, then their deviations."""
    means, deviations = [], []
    for n in LEVELS:
        for part in np.array_split(x, n, axis=1):
            width = max(part.shape[1], 1)
            mean = part.sum(axis=1) / width
            means.append(mean * np.sqrt(width))
            deviations.append(np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1)))
    return np.stack(means + deviations, axis=1)


def filled(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of ``width`` numbers, filled up with zeros."""
    out = np.zeros((len(lists), width))
    out[np.arange(width)[None, :] < np.diff(lists.offsets.to_numpy())[:, None]] = lists.flatten().to_numpy()
    return out


class Vectors:
    """Rows as arrays: ids, labels, whole-number components, and summaries by level."""

    def __init__(self, table: pa.Table, width: int):
        self.id = table.column("vec_id").to_numpy()
        self.label = table.column("label").to_numpy()
        self.x = filled(table.column("vector").combine_chunks(), width)
        count = sum(LEVELS)
        flat = filled(table.column("summary").combine_chunks(), 2 * count).astype(np.float32)
        cuts = np.cumsum((0, *LEVELS))
        self.means = [flat[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.deviations = [flat[:, count + a:count + b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.norm = np.sqrt(flat[:, 0] ** 2 + flat[:, count] ** 2)
        self.plain = not self.x.size or np.abs(self.x).max() < EXACT

    def bounds(self, level: int, rows: np.ndarray, other: Vectors, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The middle of the possible scores of ``rows`` with the rows ``columns`` of ``other``, and how far they reach from it."""
        middle = self.means[level][rows] @ other.means[level][columns].T
        reach = self.deviations[level][rows] @ other.deviations[level][columns].T
        return middle, reach + SLACK * np.outer(self.norm[rows], other.norm[columns])

    def scores(self, rows: np.ndarray, other: Vectors, k: int) -> np.ndarray:
        if self.plain and other.plain:
            return self.x[rows] @ other.x[k]
        anchor = [int(v) for v in other.x[k]]
        return np.array([sum(int(v) * a for v, a in zip(self.x[r], anchor, strict=True)) for r in rows], dtype=object)


def search(data: Vectors, anchors: Vectors, rows: np.ndarray, columns: np.ndarray, enough: Callable, most: np.ndarray | None = None) -> Iterator[tuple]:
    """For each anchor of ``columns``: (column, the rows of ``rows`` that can be asked for, their exact scores).

    ``enough(columns, scores)`` tells, from the exact scores of some rows (one column an anchor), the score below which no row can be
    asked for; none above ``most`` can. Comparisons are such that a bound that is no number keeps its row.
    """
    step = max(PAIRS // max(len(rows), 1), 1)
    for at in range(0, len(columns) if len(rows) else 0, step):
        part = columns[at:at + step]
        alive = np.ones((len(rows), len(part)), bool)
        with np.errstate(invalid="ignore", over="ignore"):
            for level in range(len(LEVELS)):
                middle, reach = data.bounds(level, rows, anchors, part)
                n = min(PROBES, len(rows))
                probes = np.argpartition(np.where(alive, middle, -np.inf), len(rows) - n, axis=0)[len(rows) - n:]
                known = np.stack([data.scores(rows[probes[:, j]], anchors, k) for j, k in enumerate(part)], axis=1).astype(float)
                floor = enough(part, known)
                alive &= ~(middle + reach < floor)
                if most is not None:
                    alive &= ~(middle - reach > most[part])
                if alive.mean() < 0.05:  # few enough to score them one by one
                    break
        for j, k in enumerate(part):
            left = rows[alive[:, j]]
            yield k, left, data.scores(left, anchors, k)


def best(ids: np.ndarray, score: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The ``n`` best (score, id), ties by the smaller id."""
    if score.dtype == object:
        return sorted(zip(score, ids.tolist(), strict=True), key=lambda x: (-x[0], x[1]))[:n]
    first = np.lexsort((ids, -score))[:n]
    return list(zip((int(v) for v in score[first]), ids[first].tolist(), strict=True))


def nth(score: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest of each column, or less than everything."""
    return np.partition(score, len(score) - n, axis=0)[len(score) - n] if len(score) >= n else np.full(score.shape[1], -np.inf)


def _table(out: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*out, strict=True) if out else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _positives(n: int, width: int, schema: pa.Schema) -> Callable:
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not len(rows) or not len(anchors):
            return schema.empty_table()
        data, asked = Vectors(rows, width), Vectors(anchors, width)
        out = []
        for label in np.unique(asked.label):
            same, columns = np.flatnonzero(data.label == label), np.flatnonzero(asked.label == label)
            # The anchor itself may be among the probes: one place more.
            for k, left, score in search(data, asked, same, columns, lambda _, known: nth(known, n + 1)):
                other = data.id[left] != asked.id[k]
                out += [(asked.id[k], p, s) for s, p in best(data.id[left][other], score[other], n)]
        return _table(out, schema)
    return run


def _negatives(n: int, low: int, high: int, width: int, schema: pa.Schema) -> Callable:
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not len(rows) or not len(anchors):
            return schema.empty_table()
        data, asked = Vectors(rows, width), Vectors(anchors, width)
        # low * s <= 100 * score <= high * s in whole numbers
        windows = [[(p["positive_id"], s, -(-low * s // 100), high * s // 100) for p in ps for s in [p["positive_score"]] if -(-low * s // 100) <= high * s // 100]
                   for ps in anchors.column("positives").to_pylist()]
        size = max(map(len, windows))
        least, most = np.full((size, len(windows)), np.inf), np.full((size, len(windows)), -np.inf)
        for k, own in enumerate(windows):
            for w, (_, _, a, b) in enumerate(own):
                least[w, k], most[w, k] = a, b

        def enough(columns: np.ndarray, known: np.ndarray) -> np.ndarray:
            floor = np.full(len(columns), np.inf)
            for w in range(size):
                a, b = least[w, columns], most[w, columns]
                floor = np.minimum(floor, np.maximum(a, nth(np.where((known >= a) & (known <= b), known, -np.inf), n)))
            return floor

        out = []
        for label in np.unique(asked.label) if size else ():
            others, columns = np.flatnonzero(data.label != label), np.flatnonzero(asked.label == label)
            for k, left, score in search(data, asked, others, columns, enough, most.max(axis=0)):
                ids = data.id[left]
                for p, s, a, b in windows[k]:
                    inside = np.array((score >= a) & (score <= b), bool)
                    out += [(asked.id[k], p, m, s, t) for t, m in best(ids[inside], score[inside], n)]
        return _table(out, schema)
    return run


def _summed(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Segments are those of the longest vector, by which all are filled up.
            rows = summary(filled(batch.column("vector"), width))
            at = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(rows.astype(np.float32).ravel()))], names=[*batch.schema.names, "summary"])
    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column ``vec_id``. An anchor's positives are its ``positives`` best other rows of its label;
    negatives are the ``negatives`` best rows of other labels with ``low`` to ``high`` percent of the positive's score.
    """
    scratch = Scratch(vectors.sparkSession)
    scaled = F.transform(F.col(vector), lambda x: F.lit(float(scale)) * x.cast("double"))
    # NaN compares above infinity.
    usable = F.forall(scaled, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    # Beyond 2^53 every double is a whole number, and floor() to a long would be cut.
    numbers = F.transform(scaled, lambda x: F.when(F.abs(x) < F.lit(2.0 ** 53), F.floor(x).cast("double")).otherwise(x))
    rows = (vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(usable)
            .select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), numbers.alias("vector")))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")
    rows = scratch.save(rows, "vectors")
    count, asked, width = rows.agg(F.count("*"), F.count_if(is_anchor), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    stored = scratch.save(rows.mapInArrow(
        _summed(width), "vec_id long, label long, vector array<double>, summary array<float>"), "summaries")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(-(-count // SLICE_ROWS), min(parts, -(-count // 512)), 1)
    sets = max(-(-asked // ANCHOR_ROWS), 1)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    data = stored.withColumns({"part": F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int"), "set": every(sets)})
    chosen = scratch.save(stored.where(is_anchor).withColumn("set", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(sets)).cast("int")), "anchors")

    def met(anchors: DataFrame, fn: Callable, schema: str) -> DataFrame:
        dealt = anchors.withColumn("part", every(slices))
        return data.groupBy("part", "set").cogroup(dealt.groupBy("part", "set")).applyInArrow(fn, schema)

    def top(found: DataFrame, keys: list[str], score: str, last: str, n: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc(score), last)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

    types = [(c, pa.int64()) for c in ("anchor_id", "positive_id", "positive_score")]
    found = met(chosen, _positives(positives, width, pa.schema(types)), "anchor_id long, positive_id long, positive_score long")
    known = top(found, ["anchor_id"], "positive_score", "positive_id", positives)
    known = known.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    known = scratch.save(known, "positives")
    pairs = chosen.join(known, chosen.vec_id == known.anchor_id).drop("anchor_id")
    types = [(c, pa.int64()) for c in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")]
    found = met(pairs, _negatives(negatives, low, high, width, pa.schema(types)),
                "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    found = top(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    out = scratch.save(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    scratch.drop("vectors", "summaries", "anchors", "positives")
    return out
