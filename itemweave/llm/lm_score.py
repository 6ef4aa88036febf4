"""Language-model scores by context-tree weighting over bytes.

A text is coded as its words (ASCII letters lower-cased) joined by single spaces and closed by an end byte. Each byte is
eight binary decisions; each decision node has a context tree over the ``depth`` bytes before it, and each tree node a
Krichevsky-Trofimov estimate of the training counts. Bottom-up, a node's weighted probability is half its own estimate
and half the product of its children's; top-down, the same ratios mix the estimates of all depths into one
prediction. Where training never saw a deeper context, the deepest one seen takes the weight that is left, so predictions
stay probabilities. The code length of a byte is the sum of its eight decisions.

How it is distributed: documents are dealt into blocks of about ``block_bytes``. A block sends each distinct gram (context
and byte) and each distinct word once, with its training count; counts are summed by gram, the trees are computed for one
pair of nearest context bytes at a time (at most 256^(depth-1) grams), and the results go back to the blocks that asked.
Only the top of the trees, at most 256 x 255 rows, passes through the driver. No table that grows with the corpus is
broadcast.

Defined cases: a NULL or empty text has no words and is the end alone; a NULL doc_id is in training; repeated rows are
scored, and counted, each by itself; without training rows all estimates are 1/2; an empty table gives an empty result;
other columns are not read; a text of any length is scored whole.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemweave.llm.common import Scratch

END = b"\n"  # no word holds it
BLOCK_BYTES, CHUNK_BYTES = 24 << 20, 1 << 20
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)
GRAM, WORD = 0, 1
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
          "n_bytes long, bits_per_byte double")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: the recurrence up to 8, then Stirling's series."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    low = x < 8
    z = np.where(low, x + 8, x)
    if low.any():
        shift = np.where(low, sum(np.log(np.where(low, x + k, 1.0)) for k in range(8)), 0.0)
    series = sum(c / z ** (2 * k + 1) for k, c in enumerate(_STIRLING))
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def chance_of_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


def coded(text: str | None) -> tuple[list[bytes], bytes]:
    """The words of a text, and its bytes for the model."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    return found, b" ".join(found) + END


def grams(data: list[bytes], depth: int) -> np.ndarray:
    """For each byte of each item: (nearest context byte, ..., farthest, the byte) as one integer, big end first."""
    pad = END * depth
    b = np.frombuffer(b"".join([x for d in data for x in (pad, d)]), np.uint8)
    n = len(b) - depth
    key = b[depth - 1:depth - 1 + n].astype(np.uint64)
    for k in range(2, depth + 1):
        key = (key << np.uint64(8)) | b[depth - k:depth - k + n]
    key = (key << np.uint64(8)) | b[depth:]
    inside = np.ones(n, bool)
    ends = np.cumsum([len(d) + depth for d in data])[:-1]
    for k in range(depth):
        inside[ends - depth + k] = False  # places of the next item's padding
    return key[inside]


def _chunks(texts) -> list[tuple[int, int]]:
    """Row ranges of about CHUNK_BYTES."""
    size = np.cumsum(texts)
    cuts, at = [0], 0
    for i, s in enumerate(size):
        if s - at >= CHUNK_BYTES:
            cuts.append(i + 1)
            at = s
    return [(a, b) for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True) if a < b]


def _sum_by_key(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


def _requests(depth: int):
    def run(table):
        pa.default_memory_pool().release_unused()  # what the last block has left
        texts, held = table.column("text"), table.column("held_out").to_pylist()
        words: Counter = Counter()
        keys, counts, size = [], [], 0
        for lo, hi in _chunks([len(t.as_py() or "") + 1 for t in texts]):
            for out in (False, True):
                part = [coded(texts[i].as_py()) for i in range(lo, hi) if held[i] == out]
                if not part:
                    continue
                key, n = np.unique(grams([d for _, d in part], depth), return_counts=True)
                keys.append(key)
                counts.append(np.zeros(len(n)) if out else n.astype(float))
                size += len(key)
                for w, _ in part:
                    if out:
                        words.update(dict.fromkeys(w, 0))
                    else:
                        words.update(w)
                words[END] += 0 if out else len(part)
            # Merge once the chunks since the last merge outweigh what it left.
            if size > max(1_000_000, len(keys[0])):
                key, n = _sum_by_key(keys, counts)
                keys, counts, size = [key], [n.astype(float)], 0
        key, n = _sum_by_key(keys, counts)
        names = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        seen = np.fromiter(words.values(), np.int64, len(words))
        del words
        block = table.column("block")[0].as_py()
        kind = np.repeat(np.array([GRAM, WORD], np.int8), [len(key), len(names)])
        return pa.table({"kind": kind, "block": np.full(len(kind), block, np.int32),
                         "key": np.concatenate([key, names]).view(np.int64), "n": np.concatenate([n, seen])})
    return run


def _expand(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight decision nodes of each gram's byte (1 to 255), and the decisions."""
    x = (key & np.uint64(255)).astype(np.int64)[:, None]
    k = np.arange(8)
    return (1 << k) | (x >> (8 - k)), (x >> (7 - k)) & 1


class Tree:
    """Nodes from ``depth`` up to ``top`` of all trees below some contexts; built from grams and counts."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int, top: int):
        node, bit = _expand(key)
        context = (key >> np.uint64(8)).astype(np.int64)[:, None]
        ids, at = np.unique(((context << 8) | node).ravel(), return_inverse=True)
        weight = np.repeat(n.astype(float), 8)
        bit = bit.ravel().astype(bool)
        zeros, ones = np.bincount(at[~bit], weight[~bit], len(ids)), np.bincount(at[bit], weight[bit], len(ids))
        self.levels = []  # from the deepest: zeros, ones, the weight of the node's own estimate, index into the level above
        below = None
        for d in range(depth, top - 1, -1):
            own = log_kt(zeros, ones)
            odds = np.full(len(ids), np.inf) if below is None else own - below
            weighted = own if below is None else np.logaddexp(own, below) - np.log(2)
            share = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
            if below is None:
                share = np.ones(len(ids))
            self.ids, self.weighted, self.zeros, self.ones = ids, weighted, zeros, ones
            if d == top:
                self.levels.append((zeros, ones, share, None))
                break
            parent, up = np.unique(((ids >> 16) << 8) | (ids & 255), return_inverse=True)
            self.levels.append((zeros, ones, share, up))
            zeros, ones = np.bincount(up, zeros, len(parent)), np.bincount(up, ones, len(parent))
            below, ids = np.bincount(up, weighted, len(parent)), parent
        self.at, self.bit = at, bit

    def log10(self, rest: np.ndarray, done: np.ndarray, last: np.ndarray) -> np.ndarray:
        """By gram; the arrays, by (nearest byte, node): what the depths above leave over, have predicted for a 1, and the
        estimate of the deepest of them that training saw."""
        path = [self.at]
        for _, _, _, up in self.levels[:-1]:
            path.append(up[path[-1]])
        top = self.ids[path[-1]]
        slot = ((top >> 16) << 8) | (top & 255)
        r, a, estimate = rest[slot], done[slot], last[slot]
        seen = np.ones(len(r), bool)
        for (zeros, ones, share, _), at in zip(reversed(self.levels), reversed(path), strict=True):
            w = share[at]
            seen = seen & (zeros + ones > 0)[at]
            estimate = np.where(seen, chance_of_one(zeros, ones)[at], estimate)
            a = np.where(seen, a + r * w * estimate, a)
            r = np.where(seen, r * (1 - w), r)
        one = a + r * estimate
        p = np.where(self.bit, one, 1 - one)
        return np.log10(p).reshape(-1, 8).sum(axis=1)


def _by_pair(compute, depth: int):
    """Feed whole groups of grams with the same two nearest bytes to ``compute``; rows come sorted by key."""
    shift = np.uint64(8 * (depth - 1))

    def run(batches):
        keys, counts = [], []

        def flush():
            key, n = np.concatenate(keys), np.concatenate(counts)
            return compute(key, n)

        held = 0
        for batch in batches:
            key, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            group = key >> shift
            # All groups but the last of the batch are complete.
            cut = int(np.searchsorted(group, group[-1])) if len(key) else 0
            if keys and len(key) and group[0] != keys[-1][-1] >> shift and held > 50_000:
                yield flush()
                keys, counts, held = [], [], 0
            if held + cut > 50_000 and cut:
                keys.append(key[:cut])
                counts.append(n[:cut])
                yield flush()
                keys, counts, held = [], [], 0
                key, n = key[cut:], n[cut:]
            if len(key):
                keys.append(key)
                counts.append(n)
                held += len(key)
        if keys:
            yield flush()
    return run


def _tops(depth: int):
    def compute(key, n):
        t = Tree(key, n, depth, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(((t.ids >> 16) << 8) | (t.ids & 255)), pa.array(t.zeros), pa.array(t.ones), pa.array(t.weighted)],
            names=["slot", "zeros", "ones", "weighted"])
    return _by_pair(compute, depth)


def _lookups(depth: int, top: tuple[np.ndarray, np.ndarray, np.ndarray]):
    def compute(key, n):
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(Tree(key, n, depth, 2).log10(*top))],
                                          names=["key", "value"])
    return _by_pair(compute, depth)


def _top_of_trees(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the sums by (nearest byte, node): what depths 0 and 1 leave over, have predicted for a 1, and the last estimate."""
    zeros, ones, below = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    for r in rows:
        at = divmod(r["slot"], 256)
        zeros[at], ones[at], below[at] = r["zeros"], r["ones"], r["weighted"]
    own = log_kt(zeros, ones)
    share = 1 / (1 + np.exp(-np.clip(own - below, -700, 700)))
    seen = zeros + ones > 0
    weighted = np.where(seen, np.logaddexp(own, below) - np.log(2), 0)
    z, o = zeros.sum(axis=0), ones.sum(axis=0)
    w = 1 / (1 + np.exp(-np.clip(log_kt(z, o) - weighted.sum(axis=0), -700, 700)))
    last = np.broadcast_to(chance_of_one(z, o), (256, 256))
    rest, done = np.broadcast_to(1 - w, (256, 256)), w * last
    last = np.where(seen, chance_of_one(zeros, ones), last)
    done = np.where(seen, done + rest * share * last, done)
    rest = np.where(seen, rest * (1 - share), rest)
    return rest.ravel(), done.ravel(), last.ravel()


def _scores(depth: int, train_tokens: int, distinct: int):
    unknown = np.log10(1 / (train_tokens + distinct + 1))

    def run(docs, replies):
        pa.default_memory_pool().release_unused()  # what the last block has left
        kind, key, value = (replies.column(c).to_numpy() for c in ("kind", "key", "value"))
        key = key.view(np.uint64)

        def sorted_side(k):
            at = np.flatnonzero(kind == k)
            order = at[np.argsort(key[at])]
            return key[order], value[order]

        gram_keys, gram_values = sorted_side(GRAM)
        word_keys, counts = sorted_side(WORD)
        del kind, key, value
        known: dict[bytes, float] = {}

        def word_value(w: bytes) -> float:
            c = counts[np.searchsorted(word_keys, np.uint64(xxhash.xxh3_64_intdigest(w)))]
            known[w] = v = float(np.log10((c + 1) / (train_tokens + distinct + 1)))
            return v

        texts, out = docs.column("text"), {k.split()[0]: [] for k in SCORES.split(", ")}
        for lo, hi in _chunks([len(t.as_py() or "") + 1 for t in texts]):
            part = [coded(texts[i].as_py()) for i in range(lo, hi)]
            key_of = grams([d for _, d in part], depth)
            distinct_keys, at = np.unique(key_of, return_inverse=True)
            bits = gram_values[np.searchsorted(gram_keys, distinct_keys)][at]
            starts = np.cumsum([0, *[len(d) for _, d in part]])
            score = np.add.reduceat(bits, starts[:-1])
            if len(known) > 150_000:
                known.clear()
            for k, (found, d) in enumerate(part):
                v = np.array([known[w] if w in known else word_value(w) for w in (*found, END)])
                out["n_tokens"].append(len(v))
                out["n_known"].append(int((v > unknown).sum()))
                out["base_score"].append(float(v.sum()))
                out["score"].append(float(score[k]))
                out["n_bytes"].append(len(d))
                out["bits_per_byte"].append(float(-score[k] / np.log10(2) / len(d)))
        out["train_tokens"] = [train_tokens] * len(texts)
        out["doc_id"], out["held_out"] = docs.column("doc_id"), docs.column("held_out")
        return pa.table({k.split()[0]: out[k.split()[0]] for k in SCORES.split(", ")})
    return run


def lm_scores(docs: DataFrame, depth: int = 5, block_bytes: int = BLOCK_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), n_bytes, bits_per_byte for each row."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows = rows.select("doc_id", "text", held.alias("held_out"),
                       F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    asked = scratch.save(rows.groupBy("block").applyInArrow(_requests(depth), "kind byte, block int, key long, n long"), "asked")
    in_grams, in_words = asked.where(F.col("kind") == GRAM), asked.where(F.col("kind") == WORD)
    counts = in_grams.groupBy("key").agg(F.sum("n").alias("n"))
    parts = max(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pair = F.shiftright("key", 8 * (depth - 1))
    counts = scratch.save(counts, "grams").repartition(parts, pair).sortWithinPartitions("key")
    tops = (counts.mapInArrow(_tops(depth), "slot long, zeros double, ones double, weighted double").groupBy("slot")
            .agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")]))
    top = _top_of_trees(tops.collect())  # at most 256 x 255 rows
    values = scratch.save(counts.mapInArrow(_lookups(depth, top), "key long, value double"), "values")
    word_counts = scratch.save(in_words.groupBy("key").agg(F.sum("n").alias("value")), "words")
    total = word_counts.where("value > 0").agg(F.sum("value"), F.count("*")).first()
    replies = (in_grams.select("kind", "block", "key").join(values, "key").select("kind", "block", "key", "value")
               .union(in_words.select("kind", "block", "key").join(word_counts, "key").select("kind", "block", "key", F.col("value").cast("double"))))
    scored = rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_scores(depth, int(total[0] or 0), int(total[1])), SCORES)
    return scratch.save(scored, "scores")
