"""Bounded-space packing of token streams into sequences of fixed length.

Each input partition keeps at most ``windows`` open windows. A document goes to the open window it fits best; if none
fits and no slot is free, the fullest window is completed with the front of the document (or padded, where its gap is
shorter than ``min_cut``) and emitted. Windows still open at the end of a partition are merged in groups of
``FAN_IN`` partitions, level by level, again with a bounded number left open, so no step sees more than
FAN_IN * windows of them.

Defined cases: a NULL or empty text is the one token ``end_id``; equal rows are packed one by one; a text of any length
is cut into as many sequences as it needs; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemweave.llm.common import Scratch

FAN_IN = 16
#: A worker forgets its cached words, and the pieces of words, beyond so many.
CACHED_WORDS = 800_000
#: Pieces that go to the tokenizer as one text.
JOINED = 256

# Ids are four bytes each in the machine's order, which is the little-endian one wherever Spark runs.
assert array("I", [1]).tobytes() == b"\x01\0\0\0"

_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, win long, offset long, "
           "open boolean")


# Letters that are lower-cased one by one, and that no normal form changes or joins: those below U+02B0 but for \u0130.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff\u0100-\u012f\u0131-\u02af"
_OTHERS = "\u00ab\u00bb\u2013\u2014\u2018-\u201e\u2026"  # quotes, dashes and dots, neither letters nor numbers
_PLAIN = re.compile(f"[!-~A-Z{_LETTERS}\u00c0-\u00d6\u00d8-\u00de{_OTHERS}]+")
#: The steps ahead of the vocabulary for which the two patterns hold; others take all words one by one.
_STEPS = {"normalizer": {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


class WordTokenizer:
    """Ids of a text as bytes (little-endian unsigned 32-bit), by words of the text.

    The vocabulary's splitter never joins characters across ASCII white space, so a text's ids are those of its words
    one after another, and each distinct word goes to the tokenizer once. Words are cached up to CACHED_WORDS.

    A new word of plain characters is cut where the vocabulary's own splitter cuts it, so case and punctuation make no new
    pieces; new pieces go to the vocabulary many at a time, separated by spaces, and the ids that end a piece, those of the
    tokens with the end suffix, say which are whose. Other words go through the whole tokenizer one by one.
    """

    _loaded: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        suffix = steps["model"].get("end_of_word_suffix")
        self.plain = None  # the vocabulary without the steps that plain pieces do not need
        if suffix and all(steps[k] == v for k, v in _STEPS.items()):
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.plain.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.cache: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> WordTokenizer:
        """One for each worker process, kept between tasks."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode(self, text: str | bytes | None) -> bytes:
        found = (text if isinstance(text, bytes) else (text or "").encode("utf-8", "replace")).split()
        cache = self.cache
        try:
            return b"".join(map(cache.__getitem__, found))
        except KeyError:
            pass
        if len(cache) > CACHED_WORDS:
            cache.clear()
        if len(self.pieces) > CACHED_WORDS:
            self.pieces.clear()
        missing = list(set(found).difference(cache))
        for i in range(0, len(missing), 20_000):
            self._learn(missing[i:i + 20_000])
        return b"".join(map(cache.__getitem__, found))

    def _learn(self, missing: list[bytes]) -> None:
        """Put new words into the cache."""
        cut, alone, pieces, asked = [], [], self.pieces, set()
        for w in missing:
            text = w.decode("utf-8")
            if self.plain and text.isalpha() and text.isascii():
                cut.append((w, low := text.lower()))
                asked.add(low)
            # Special tokens are found ahead of the splitter.
            elif self.plain and "<|" not in text and _PLAIN.fullmatch(text):
                cut.append((w, some := _PIECE.findall(text.lower())))
                asked.update(some)
            else:
                alone.append(w)
        if new := list(asked.difference(pieces)):
            ids = array("I")
            for e in self._ids(self.plain, [" ".join(new[i:i + JOINED]) for i in range(0, len(new), JOINED)]):
                ids.extend(e)
            at = [0, *((np.flatnonzero(self.ends[np.frombuffer(ids, np.uint32)]) + 1) * 4).tolist()]
            if len(at) != len(new) + 1 or at[-1] != len(ids) * 4:
                raise ValueError(f"the tokenizer cut {len(new)} pieces into {len(at) - 1}")
            data = ids.tobytes()
            pieces.update((p, data[x:y]) for p, x, y in zip(new, at, at[1:], strict=False))
        for w, c in cut:
            self.cache[w] = pieces[c] if isinstance(c, str) else b"".join([pieces[p] for p in c])
        for w, e in zip(alone, self._ids(self.tokenizer, [w.decode("utf-8") for w in alone]), strict=True):
            self.cache[w] = array("I", e).tobytes()

    def _ids(self, tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


class OpenWindows:
    """At most ``limit`` windows of ``size`` tokens that still take items; place() says which window an item goes to."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit, self.next = size, limit, 0
        self.fill: dict[int, int] = {}

    def new(self, length: int) -> int:
        self.next += 1
        self.fill[self.next - 1] = length
        return self.next - 1

    def best(self, length: int) -> int | None:
        """The fullest open window with room for the item."""
        most, found, room = -1, None, self.size - length
        for w, f in self.fill.items():
            if most <= f <= room and (f > most or w < found):
                most, found = f, w
        return found

    def fullest(self) -> int:
        return min(self.fill, key=lambda w: (-self.fill[w], w))


def _pack_partition(batches: Iterator[pa.RecordBatch], encode, end: bytes, size: int, limit: int, min_cut: int, part: int):
    state, held, out = OpenWindows(size, limit), {}, []

    def put(win: int, piece: tuple, offset: int) -> None:
        held.setdefault(win, []).append((*piece, part, win, offset))

    def close(win: int) -> None:
        state.fill.pop(win)
        out.extend((*p, False) for p in held.pop(win))

    def flush():
        cols = list(zip(*out, strict=True)) or [()] * 9
        kinds = [pa.int64()] * 8 + [pa.bool_()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                          names=[x.split()[0] for x in _PIECES.split(", ")])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            ids = encode(text.as_py()) + end
            total, at = len(ids) // 4, 0

            def piece(n: int):
                return doc, at, n, zlib.crc32(ids[4 * at:4 * (at + n)]), total  # noqa: B023

            while total - at >= size:
                win = state.new(size)
                put(win, piece(size), 0)
                close(win)
                at += size
            while (left := total - at) > 0:
                win = state.best(left)
                if win is None and len(state.fill) >= state.limit:
                    full = state.fullest()
                    if (gap := size - state.fill[full]) >= min_cut:
                        put(full, piece(gap), state.fill[full])
                        at += gap
                    close(full)
                    continue
                if win is None:
                    win = state.new(0)
                put(win, piece(left), state.fill[win])
                state.fill[win] += left
                at = total
                if state.fill[win] == size:
                    close(win)
        yield flush()
    for win in list(held):
        out.extend((*p, True) for p in held.pop(win))
    yield flush()


def _merge(windows: DataFrame, level: int, size: int, limit: int, last: bool) -> DataFrame:
    """Merge whole windows of FAN_IN partitions, fullest first; all but ``limit`` are then closed."""

    def merge(key, t):
        rows = sorted(t.to_pylist(), key=lambda r: (-r["fill"], r["part"], r["win"]))
        state, members = OpenWindows(size, len(rows)), {}
        for r in rows:
            win = state.best(r["fill"])
            win = state.new(0) if win is None else win
            shift = state.fill[win]
            members.setdefault(win, []).extend({"part": m["part"], "win": m["win"], "shift": m["shift"] + shift} for m in r["members"])
            state.fill[win] += r["fill"]
        group = key[0].as_py()
        order = sorted(state.fill, key=lambda w: (state.fill[w], w))
        keep = set() if last else {w for w in order[:limit] if state.fill[w] < size}
        return pa.Table.from_pylist(
            [{"part": group, "win": w, "fill": state.fill[w], "level": level, "open": w in keep, "members": members[w]} for w in state.fill],
            schema=schema)

    member = pa.struct([("part", pa.int64()), ("win", pa.int64()), ("shift", pa.int64())])
    schema = pa.schema([("part", pa.int64()), ("win", pa.int64()), ("fill", pa.int64()), ("level", pa.int64()),
                        ("open", pa.bool_()), ("members", pa.list_(member))])
    return windows.groupBy(F.floor(F.col("part") / FAN_IN).cast("long").alias("g")).applyInArrow(
        merge, "part long, win long, fill long, level long, open boolean, members array<struct<part: long, win: long, shift: long>>")


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, windows: int = 64, min_cut: int = 32,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encode = WordTokenizer.load(tokenizer).encode
        return _pack_partition(batches, encode, end, size, windows, min_cut, TaskContext.get().partitionId())

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = scratch.save(rows.mapInArrow(run, _PIECES), "pieces")
    one = F.array(F.struct("part", "win", F.lit(0).cast("long").alias("shift")))
    left = scratch.save(pieces.where("open").groupBy("part", "win").agg(F.sum("length").alias("fill"))
                        .select("part", "win", "fill", one.alias("members")), "left0")
    done, level = [], 0
    top = left.agg(F.max("part")).first()[0]
    while top is not None:
        level += 1
        last = top < FAN_IN
        merged = scratch.save(_merge(left, level, size, windows, last), f"merged{level}")
        done.append(merged.where(~F.col("open")))
        left, top = merged.where("open").select("part", "win", "fill", "members"), None if last else top // FAN_IN

    def sequence(level, part="part"):
        return (F.lit(level).cast("long") * F.lit(1 << 57) + F.col(part) * F.lit(1 << 30) + F.col("win")).alias("sequence_id")

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    out = pieces.where(~F.col("open")).select(*columns, sequence(0), "offset")
    if done:
        moved = done[0]
        for d in done[1:]:
            moved = moved.union(d)
        moved = moved.select((F.col("level") * F.lit(1 << 57) + F.col("part") * F.lit(1 << 30) + F.col("win")).alias("sequence_id"),
                             F.explode("members").alias("m")).select("sequence_id", "m.part", "m.win", "m.shift")
        out = out.union(pieces.where("open").join(moved, ["part", "win"])
                        .select(*columns, "sequence_id", (F.col("offset") + F.col("shift")).alias("offset")))
    return out
