"""Repeated byte strings across documents by sorting sampled suffixes and inducing the others.

Each byte inside a ``length``-byte string that also starts in a document with a smaller doc_id is removed. As in induced
sorting, a sample of the suffixes is sorted outright and what holds for the others follows from their neighbours:

1. A place is sampled if a hash of its GRAM bytes is the least in some window of ``length`` bytes (instead of the type
   of its suffix, whose gaps have no bound). Equal windows hold the same sampled place at the same offset.
2. Suffix tuples (gram, document) are sorted in runs by block, split into ranges by Spark's shuffle, and merged by range;
   grams of a single document go.
3. Tuples of the others carry the hash of their whole surroundings: the bytes from ``length - GRAM`` before to ``length``
   behind the place, which hold all windows around it. If the same surroundings exist in a smaller document, all of
   these windows are repeats, with no further comparison.
4. Only where one gram has several surroundings (at the ends of a passage, or at an edit) are single windows sorted, one
   representative for each surroundings.

The runs and their disk are Spark's rows and shuffle files; a range holds a bounded number of tuples. Each key costs at
most one tuple for each block of documents, so hot passages are not heavier than rare ones. Strings are compared by
64-bit hashes.

Defined cases: a NULL text is empty; rows that share a doc_id are not repeats of each other, also when they are equal; a
NULL doc_id counts as larger than any other; an empty table gives an empty result; other columns are not read; texts
are read whole, as UTF-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemweave.llm.blocks import Blocks, chunks, contained, sampled, select_runs, sliding, starts, to_runs, unpacked
from itemweave.llm.common import Scratch
from itemweave.llm.shingles import mix

GRAM = 24
#: Texts hashed at a time: arrays of 64-bit values over them stay near the caches.
CHUNK_BYTES = 512 << 10
#: Blocks are smaller by this, so that a worker's tables and arrays are too.
FINER = 3
LAST = (1 << 63) - 1  # stands for a NULL doc_id
OUT = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, "
       "spans array<struct<start: long, length: long>>")
_WEIGHTS = np.random.default_rng(20).integers(1, 1 << 63, 4096, np.int64).astype(np.uint64) | np.uint64(1)


class Suffixes:
    """Grams and windows of some texts laid end to end. The order of the grams is that of a 32-bit hash; equal ones tie."""

    def __init__(self, texts: list[bytes | None], length: int):
        self.data = [t or b"" for t in texts]
        sizes = np.array([len(d) for d in self.data], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        joined = b"".join(self.data)
        self.n, self.length, self.reach = len(joined), length, length - GRAM
        self.bytes = np.frombuffer(joined, np.uint8)
        padded = joined + bytes(16)
        self.eight = np.empty(self.n, np.uint64)  # the eight bytes from each place
        for k in range(min(8, self.n)):
            self.eight[k::8] = np.frombuffer(padded, "<u8", (self.n - k + 7) // 8, k)
        n, e, w = max(self.n - GRAM + 1, 0), self.eight, _WEIGHTS
        order = e[:n] * w[5]
        for k in range(8, GRAM, 8):
            order += e[k:k + n] * w[5 + k // 8]
        order >>= np.uint64(32)
        self.order = order.astype(np.uint32) | np.uint32(1)
        n = max(self.n - length + 1, 0)
        self.low = sliding(self.order, self.reach + 1) if n else np.zeros(0, np.uint32)
        self.valid = np.ones(n, bool)
        for lo, hi in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            self.valid[max(lo, hi - length + 1):hi] = False

    def sampled(self) -> np.ndarray:
        return sampled(self.order, self.low, self.valid, self.reach + 1) if len(self.low) else np.zeros(0, np.int64)

    def doc(self, at: np.ndarray) -> np.ndarray:
        """The number of the text that holds each place."""
        return np.searchsorted(self.starts, at, "right") - 1

    def gram(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(0, GRAM, 8):
            out = mix(out * _WEIGHTS[0] + self.eight[at + k])
        return out

    def surroundings(self, at: np.ndarray) -> np.ndarray:
        """A hash of the bytes from ``reach`` before to ``length`` behind each place, as far as its document goes.

        Surroundings that lie inside the document are hashed eight bytes at a time; those that its ends cut, byte by byte.
        The two never are equal, as a cut is part of what must agree.
        """
        doc = self.doc(at)
        lo, hi = self.starts[doc], self.starts[doc + 1]
        inside = (at - self.reach >= lo) & (at + self.length <= hi)
        out = np.empty(len(at), np.uint64)
        whole, cut = at[inside], np.flatnonzero(~inside)
        h = np.zeros(len(whole), np.uint64)
        for k in [*range(-self.reach, self.length - 8, 8), self.length - 8]:
            h = mix(h * _WEIGHTS[4] + self.eight[whole + k])
        out[inside] = h
        around = np.arange(-self.reach, self.length)
        for some in np.array_split(cut, len(cut) // 4096 + 1):
            p = at[some, None] + around
            v = np.where((p >= lo[some, None]) & (p < hi[some, None]), self.bytes[np.clip(p, 0, self.n - 1)], np.uint64(256)) + np.uint64(1)
            out[some] = mix((v * _WEIGHTS[around + self.reach]).sum(axis=1, dtype=np.uint64))
        return out

    def windows_of(self, at: np.ndarray) -> np.ndarray:
        """The valid windows whose least gram is that of one of some sampled places inside them."""
        if not len(at):
            return at
        own = np.full(len(self.order), np.iinfo(np.uint32).max, np.uint32)
        own[at] = self.order[at]
        return np.flatnonzero((sliding(own, self.reach + 1)[:len(self.low)] == self.low) & self.valid)

    def hashes(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in [*range(0, self.length - 8, 8), self.length - 8]:
            out = mix(out * _WEIGHTS[2] + self.eight[at + k])
        return out


def _parts(table: pa.Table, length: int):
    texts = table.column("text").cast(pa.binary())
    ids = np.array([LAST if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)
    for lo, hi in chunks([n or 0 for n in pc.add(pc.binary_length(texts), 1).to_pylist()], CHUNK_BYTES):
        s = Suffixes(texts.slice(lo, hi - lo).to_pylist(), length)
        yield lo, s, ids[lo:hi]


def _distinct(keys: list[np.ndarray], docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, sorted, with the smallest and the largest document of each."""
    key, doc = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *docs])
    order = np.argsort(key)
    key, doc = key[order], doc[order]
    first = starts(key)
    return (key[first], np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)) if len(first) else (key, doc, doc)


def _block(table: pa.Table, other: pa.Table | None = None) -> int:
    return (table if len(table) else other).column("block")[0].as_py()


def _grams(length: int, ranges: int):
    def run(table):
        keys, docs = [], []
        for _, s, ids in _parts(table, length):
            at = s.sampled()
            keys.append(s.gram(at))
            docs.append(ids[s.doc(at)])
        key, lo, hi = _distinct(keys, docs)
        return to_runs(_block(table), ranges, key, two=(lo < hi).astype(np.uint8))
    return run


def _in_two_documents(runs: pa.Table) -> pa.Table:
    """The grams of several blocks, or of several documents of one; those of one document in two blocks do no harm."""
    key, two = unpacked(runs, "key", np.uint64), unpacked(runs, "two", np.uint8)
    order = np.argsort(key)
    first = starts(key[order])
    size = np.diff(np.append(first, len(key)))
    keep = np.empty(len(key), bool)
    keep[order] = np.repeat((size > 1) | (np.maximum.reduceat(two[order], first) > 0), size)
    return select_runs(runs, keep, key=key)


def _contexts(length: int, ranges: int):
    def run(table, answers):
        shared, seen = np.sort(unpacked(answers, "key", np.uint64)), []
        for _, s, ids in _parts(table, length) if len(shared) else ():
            at = s.sampled()
            gram = s.gram(at)
            known = contained(shared, gram)
            at, gram = at[known], gram[known]
            seen.append((gram, s.surroundings(at), ids[s.doc(at)]))
        none = (shared[:0], shared[:0], np.zeros(0, np.int64))
        gram, context, doc = (np.concatenate(c) for c in zip(none, *seen, strict=True))
        order = np.lexsort((context, gram))
        gram, context, doc = gram[order], context[order], doc[order]
        first = _pairs(gram, context)
        lo, hi = (np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)) if len(first) else (doc, doc)
        return to_runs(_block(table, answers), ranges, gram[first], context=context[first], doc=lo, more=hi - lo)
    return run


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where each run of equal pairs starts."""
    return np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)


def _first_contexts(runs: pa.Table) -> pa.Table:
    """For each tuple, the smallest document with its surroundings, and whether its gram has others."""
    key, context = (unpacked(runs, c, np.uint64) for c in ("key", "context"))
    doc, more = (unpacked(runs, c, np.int64) for c in ("doc", "more"))
    order = np.lexsort((context, key))
    first = _pairs(key[order], context[order])
    size = np.diff(np.append(first, len(key)))
    by_key = starts(key[order][first])
    several = np.repeat(np.diff(np.append(by_key, len(first))), np.diff(np.append(by_key, len(first)))) > 1
    lowest, others = np.empty(len(key), np.int64), np.empty(len(key), bool)
    lowest[order] = np.repeat(np.minimum.reduceat(doc[order], first), size)
    others[order] = np.repeat(several, size)
    keep = others | (lowest < doc + more)
    return select_runs(runs, keep, key=key, context=context, doc=lowest, several=others.astype(np.uint8))


class Answers:
    """What a block was told about its sampled places: (gram, surroundings) with the smallest document."""

    def __init__(self, rows: pa.Table):
        key, context = (unpacked(rows, c, np.uint64) for c in ("key", "context"))
        name = mix(key * _WEIGHTS[3] + context)
        order = np.argsort(name)
        self.grams, self.name = np.sort(key), name[order]
        self.doc, self.several = unpacked(rows, "doc", np.int64)[order], unpacked(rows, "several", np.uint8)[order] > 0

    def look_up(self, s: Suffixes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled places whose surroundings exist in a smaller document, and those to settle by windows."""
        at = s.sampled()
        gram = s.gram(at)
        known = contained(self.grams, gram)
        at, gram = at[known], gram[known]
        if not len(at):
            return at, at
        name = mix(gram * _WEIGHTS[3] + s.surroundings(at))
        i = np.minimum(np.searchsorted(self.name, name), len(self.name) - 1)
        known, own = self.name[i] == name, ids[s.doc(at)]
        return at[known & (self.doc[i] < own)], at[known & (self.doc[i] >= own) & self.several[i]]


def _windows(length: int, ranges: int):
    def run(table, answers):
        told, keys, docs = Answers(answers), [], []
        for _, s, ids in _parts(table, length) if len(answers) else ():
            whole, rest = told.look_up(s, ids)
            w = s.windows_of(rest)
            # A window beside a place that is settled is a repeat already, and so not the first of its kind.
            edge = np.zeros(s.n + 1, np.int32)
            np.add.at(edge, np.maximum(whole - s.reach, s.starts[s.doc(whole)]), 1)
            np.add.at(edge, whole + 1, -1)
            w = w[np.cumsum(edge)[w] == 0]
            keys.append(s.hashes(w))
            docs.append(ids[s.doc(w)])
        key, lo, hi = _distinct(keys, docs)
        return to_runs(_block(table, answers), ranges, key, lo=lo, more=hi - lo)
    return run


def _first_windows(runs: pa.Table) -> pa.Table:
    key, lo = unpacked(runs, "key", np.uint64), unpacked(runs, "lo", np.int64)
    order = np.argsort(key)
    first = starts(key[order])
    lowest = np.empty(len(key), np.int64)
    lowest[order] = np.repeat(np.minimum.reduceat(lo[order], first), np.diff(np.append(first, len(key))))
    return select_runs(runs, lowest < lo + unpacked(runs, "more", np.int64), key=key, doc=lowest)


def _mark(length: int, texts: bool):
    names = [c.split()[0] for c in OUT.split(", ")[:7]][:7 if texts else 5]
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), spans]

    def run(table, answers):
        is_window = answers.column("is_window").to_numpy().astype(bool)
        contexts, single = answers.filter(pa.array(~is_window)), answers.filter(pa.array(is_window))
        told, any_told = Answers(contexts), len(contexts) > 0
        key, doc = unpacked(single, "key", np.uint64), unpacked(single, "doc", np.int64)
        order = np.argsort(key)
        key, doc = key[order], doc[order]
        out = {c: [] for c in names}
        for lo, s, ids in _parts(table, length):
            whole, rest = told.look_up(s, ids) if any_told else (np.zeros(0, np.int64),) * 2
            own = s.doc(whole)
            a, b = np.maximum(whole - s.reach, s.starts[own]), np.minimum(whole + length, s.starts[own + 1])
            w = s.windows_of(rest) if len(key) else rest[:0]
            h = s.hashes(w)
            i = np.minimum(np.searchsorted(key, h), max(len(key) - 1, 0))
            w = w[(key[i] == h) & (doc[i] < ids[s.doc(w)])] if len(w) else w
            edge = np.zeros(s.n + 1, np.int32)
            for at, by in ((a, 1), (b, -1), (w, 1), (w + length, -1)):
                np.add.at(edge, at, by)
            gone = np.cumsum(edge[:-1]) > 0
            for k, data in enumerate(s.data):
                own = gone[s.starts[k]:s.starts[k + 1]]
                step = np.flatnonzero(np.diff(own, prepend=False, append=False)).reshape(-1, 2) if own.any() else np.zeros((0, 2), np.int64)
                kept = s.bytes[s.starts[k]:s.starts[k + 1]][~own].tobytes() if len(step) else data
                row = [None, len(data), len(data) - len(kept), len(step), hashlib.sha256(kept).hexdigest()]
                if texts:
                    row += [kept, [{"start": int(x), "length": int(y - x)} for x, y in step]]
                for name, v in zip(names, row, strict=True):
                    out[name].append(v)
        out["doc_id"] = table.column("doc_id").to_pylist()
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=False)], names=names)
    return run


def repeated_bytes(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and, with ``texts``, kept (bytes that stay) and spans (that go)."""
    if length < 2 * GRAM:
        raise ValueError(f"a string has at least {2 * GRAM} bytes")
    scratch = Scratch(docs.sparkSession)
    blocks = Blocks(docs, doc_id, text, finer=FINER)
    ranges, runs = blocks.ranges, "range int, block int, key binary"
    grams = scratch.save(blocks.merge(blocks.ask(_grams(length, ranges), f"{runs}, two binary"), _in_two_documents, "block int, key binary"), "grams")
    contexts = blocks.tell(grams, _contexts(length, ranges), f"{runs}, context binary, doc binary, more binary")
    contexts = scratch.save(blocks.merge(contexts, _first_contexts, "block int, key binary, context binary, doc binary, several binary"), "contexts")
    scratch.drop("grams")
    windows = blocks.tell(contexts, _windows(length, ranges), f"{runs}, lo binary, more binary")
    windows = scratch.save(blocks.merge(windows, _first_windows, "block int, key binary, doc binary"), "windows")
    none = F.lit(None).cast("binary")
    told = contexts.withColumn("is_window", F.lit(0).cast("byte")).unionByName(
        windows.withColumns({"is_window": F.lit(1).cast("byte"), "context": none, "several": none}))
    out = scratch.save(blocks.tell(told, _mark(length, texts), OUT if texts else OUT[:OUT.index(", kept binary")]), "marked")
    scratch.drop("contexts", "windows")
    return out
