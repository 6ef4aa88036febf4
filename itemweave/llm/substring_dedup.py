"""Repeated word sequences by prefix-partitioned groups of sampled suffixes.

A window is ``window`` consecutive words of one document; each word inside a window that starts anywhere else too is
removed. The suffixes that start at sampled places are split by prefixes of growing length. The first prefix is GRAM words; a place is sampled if its gram has the least hash among the grams of some window, so equal
windows hold the same sampled prefix at the same offset, whatever stands around them. Prefixes that occur once are
leaves of the suffix tree and go. The windows around the others are split by all ``window`` words: a group of two or more is an internal
node of depth ``window``, the only depth that the removal needs, and its members' words are marked.

Groups meet in Spark's sorted shuffle, at most one row for each group and block of documents (with the number of its
occurrences), so a passage in a third of all documents is as cheap as a rare one. Words are compared by 64-bit hashes.

Defined cases: a NULL, empty or blank text has no words; repeated rows are copies of each other, so all their windows go,
as for any text that occurs twice; a NULL doc_id is an id like others; an empty table gives an empty result; other
columns are not read; texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from itemweave.llm.blocks import Blocks, chunks, contained, sampled, sliding, starts
from itemweave.llm.common import Scratch
from itemweave.llm.shingles import mix, windows, word_hashes

GRAM = 8
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start: long, length: long>>"


class Windows:
    """Grams, windows and samples of some texts laid end to end."""

    def __init__(self, texts: list[str | None], window: int):
        self.words = [(t or "").encode("utf-8", "replace").split() for t in texts]
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        h = np.concatenate([word_hashes(w) for w in self.words])
        self.n = len(h)
        self.gram = windows(h, GRAM)
        n = max(self.n - window + 1, 0)
        self.low = sliding(self.gram, window - GRAM + 1) if n else np.zeros(0, np.uint64)
        ends = np.repeat(self.starts[1:], lengths)
        self.valid = np.arange(n) + window <= ends[:n]
        self.window = window

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows that start at some places, from the grams that cover them."""
        out = np.zeros(len(at), np.uint64)
        for k in [*range(0, self.window - GRAM, GRAM), self.window - GRAM]:
            out = out * np.uint64(0x9E3779B97F4A7C15) + self.gram[at + k]
        return mix(out)


def _count(key: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(key) if key else np.zeros(0, np.uint64), return_counts=True)


def _parts(table: pa.Table, window: int):
    texts = table.column("text")
    for lo, hi in chunks([len(t.as_py() or "") + 1 for t in texts]):
        yield lo, hi, Windows([texts[i].as_py() for i in range(lo, hi)], window)


def _asked(table: pa.Table, key: np.ndarray, n: np.ndarray) -> pa.Table:
    block = table.column("block")[0].as_py()
    return pa.table({"key": key.view(np.int64), "block": np.full(len(key), block, np.int32), "n": n.astype(np.int64)})


def _prefixes(window: int):
    def run(table):
        keys = []
        for _, _, w in _parts(table, window):
            if len(w.low):
                keys.append(w.gram[sampled(w.gram, w.low, w.valid, window - GRAM + 1)])
        return _asked(table, *_count(keys))
    return run


def _candidates(w: Windows, shared: np.ndarray) -> np.ndarray:
    """The windows whose least gram is a shared prefix."""
    at = np.flatnonzero(w.valid)
    return at[contained(shared, w.low[at])]


def _keys(answers: pa.Table) -> np.ndarray:
    return np.sort(answers.column("key").to_numpy().view(np.uint64))


def _windows(window: int):
    def run(table, answers):
        if not len(table):
            return _asked(answers, np.zeros(0, np.uint64), np.zeros(0))
        shared, keys = _keys(answers), []
        for _, _, w in _parts(table, window):
            keys.append(w.hashes(_candidates(w, shared)))
        return _asked(table, *_count(keys))
    return run


def _repeated(rows: pa.Table) -> pa.Table:
    """The rows of keys that occur at least twice."""
    key, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
    first = starts(key)
    total = np.add.reduceat(n, first)
    keep = np.repeat(total >= 2, np.diff(np.append(first, len(key))))
    return rows.select(["key", "block"]).filter(pa.array(keep))


def _mark(window: int):
    def run(table, answers):
        out = {c.split()[0]: [] for c in OUT.split(", ")[:5]} | {"spans": []}
        shared = _keys(answers)
        for lo, _, w in _parts(table, window):
            at = np.flatnonzero(w.valid)
            at = at[contained(shared, w.hashes(at))]
            edge = np.zeros(w.n + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            for k, words in enumerate(w.words):
                own = gone[w.starts[k]:w.starts[k + 1]]
                step = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                kept = b" ".join([x for x, g in zip(words, own.tolist(), strict=True) if not g] if own.any() else words)
                for name, v in (("doc_id", table.column("doc_id")[lo + k].as_py()), ("n_words", len(words)), ("n_removed", int(own.sum())),
                                ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept.decode()),
                                ("spans", [{"start": int(a), "length": int(b - a)} for a, b in step.reshape(-1, 2)])):
                    out[name].append(v)
        spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), spans]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))
    return run


def repeated_words(docs: DataFrame, window: int = 35, doc_id: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and, with ``texts``, kept (the words that stay) and spans (word ranges that go)."""
    if window < 2 * GRAM:
        raise ValueError(f"a window has at least {2 * GRAM} words")
    scratch = Scratch(docs.sparkSession)
    blocks = Blocks(docs, doc_id, text)
    rows = "key long, block int, n long"
    prefixes = scratch.save(blocks.meet(blocks.ask(_prefixes(window), rows), _repeated, "key long, block int"), "prefixes")
    found = scratch.save(blocks.meet(blocks.tell(prefixes, _windows(window), rows), _repeated, "key long, block int"), "windows")
    out = blocks.tell(found, _mark(window), OUT)
    out = scratch.save(out if texts else out.drop("kept", "spans"), "marked")
    scratch.drop("prefixes", "windows")
    return out
