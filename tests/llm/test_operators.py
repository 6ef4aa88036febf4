"""Each operator against a brute-force version on small rows with hard cases: NULLs, blanks, repeats, ties, clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from itemweave.llm import blocks, decontam, html_extract, jaccard, lm_score, packing, quality, suffix_dedup
from itemweave.llm.common import Scratch, components
from itemweave.llm.decontam import drop_leaks, leaks
from itemweave.llm.html_extract import main_text
from itemweave.llm.jaccard import jaccard_components, keep_one
from itemweave.llm.line_dedup import drop_lines, line_dedup
from itemweave.llm.lm_score import lm_scores
from itemweave.llm.packing import pack
from itemweave.llm.quality import keep_quality, quality_scores
from itemweave.llm.queries import tokenizer_path
from itemweave.llm.substring_dedup import repeated_words
from itemweave.llm.suffix_dedup import repeated_bytes
from itemweave.llm.url_filter import evaluate

# Names that the operators use inside come as further columns.
SCHEMA = "doc_id long, text string, n long, h string, key string, block int, `__row` int, kept string"


def _texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "to", "in", "Ab", "ñandú", "río", "x1", "is"] + [f"w{k}" for k in range(400)]

    def prose(n, names=vocabulary):
        return " ".join(rng.choice(names) for _ in range(n))

    passage, long_line = prose(70), prose(30)
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "One"), (6, "two words"), (None, prose(60)), (None, None)]
    k = 10
    for _ in range(12):
        rows.append((k := k + 1, prose(rng.randint(20, 120)) + "\n" + prose(12)))
    for _ in range(4):
        rows.append((k := k + 1, prose(15) + " " + passage + "\n" + prose(25)))
    base = prose(200).split(" ")
    for j in range(8):  # near copies, linked in a chain
        copy = list(base)
        for p in range(j):
            copy[20 * p + 3] = f"edit{j}{p}"
        rows.append((k := k + 1, " ".join(copy)))
    copied = prose(90)
    rows += [(k := k + 1, copied) for _ in range(3)]
    rows += [(k := k + 1, "a b " * 60), (k := k + 1, "x" * 300), (k := k + 1, "!" + long_line + "\n" + long_line + "\n" + long_line[:-1] + "\n" + long_line.replace("w", "v", 1))]
    rows += [(k := k + 1, prose(2500))]  # long beside the others
    rows.append((rows[9][0], rows[9][1]))  # a repeated row
    return rows


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7, "h", "k", 1, 2, "kept") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def same(got: list[tuple], want: list[tuple]) -> None:
    assert sorted(got, key=repr) == sorted(want, key=repr)


# --- 1 ------------------------------------------------------------------------------------------


def edit(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows, min_chars=20):
    order = lambda r: (r[0] is not None, r[0] or 0)
    first: dict[str, tuple] = {}
    for i, t in sorted(set(rows), key=order):
        for p, line in enumerate((t or "").split("\n")):
            if split_words(line):
                first.setdefault(line, (order((i, t)), t, p))
    gone = {x for x in first if len(x) >= min_chars and any(
        first[y][0] < first[x][0] or first[y][0] == first[x][0] and first[y][2] < first[x][2] for y in first
        if y != x and abs(len(x) - len(y)) < 2 and edit(x, y) == 1)}
    out = []
    for i, t in rows:
        lines = [(p, x) for p, x in enumerate((t or "").split("\n")) if split_words(x)]
        kept = [x for p, x in lines if x not in gone and first[x] == (order((i, t)), t, p)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup(docs, empty):
    want = brute_lines(TEXTS)
    assert sum(r[3] for r in want) >= 5
    same([tuple(r) for r in line_dedup(docs).collect()], want)
    assert line_dedup(empty).count() == 0 and drop_lines(empty).count() == 0
    left = drop_lines(docs)
    assert left.columns == docs.columns
    same([(r.doc_id, r.text) for r in left.collect()], [(w[0], w[1] if w[2] else t) for w, (_, t) in zip(want, TEXTS, strict=True) if not w[2] or w[2] > w[3]])


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_finds_every_edit(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé d") for _ in range(n)).strip().ljust(n, "q") for n in (22, 23, 33, 64, 127, 300)]
    rows = [(1, "\n".join(base))]
    for k, line in enumerate(base):
        for p in (0, 1, len(line) // 2, len(line) - 2, len(line) - 1):
            rows += [(100 + k, line[:p] + "Z" + line[p:]), (200 + k, line[:p] + line[p + 1:]), (300 + k, line[:p] + "Z" + line[p + 1:]),
                     (400 + k, line[:p] + "ZY" + line[p + 2:] + "YZ")]
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    # Rows with one doc_id and different texts: later texts are ordered by a hash, so only totals are compared there.
    lone = Counter(i for i, _ in rows)
    want = [w for w in brute_lines(rows) if w[0] < 400]
    assert [g for g in got if g[0] == 1] == [w for w in want if w[0] == 1]
    assert sum(g[3] for g in got if g[0] < 400) == sum(n for i, n in lone.items() if 100 <= i < 400)


# --- 2 ------------------------------------------------------------------------------------------


def test_url_filters(spark):
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    entries = [("example.org", day(1), "block"), ("example.org", day(30), "allow"), ("a.example.org/x", day(5), "block"),
               ("a.example.org/x", day(5), "allow"), ("org", day(40), "block"), (None, day(1), "block"), ("b.org", None, "block"), ("b.org", day(2), "block")]
    urls = ["http://a.example.org/x/y?q", "HTTPS://u@A.Example.org:80/xy", "example.org", "http://badexample.org/", "", None, "http://b.org./#f"]
    captures = [(u, day(d) if d is not None else None, "p", 1) for u in urls for d in (0, 1, 4.5, 5, 29.9, 30, 41, 400, None)] * 2
    df = spark.createDataFrame(captures, "url string, fetched timestamp, period string, start int")
    log = spark.createDataFrame(entries, "pattern string, ts timestamp, action string")

    def covers(p, url):
        m = re.match(r"^(?:[a-z]+:)?(?://)?(?:[^/@]*@)?([^/?#:]*?)\.?(?::\d+)?((?:/[^?#]*)?)(?:[?#]|$)", url.lower())
        h, path = m[1], m[2].rstrip("/")
        if "/" in p:
            return (h + path + "/").startswith(p + "/")
        return bool(h) and ("." + h).endswith("." + p)

    want = []
    for u, at, *_ in captures:
        best = None
        if u and at:
            for p in {e[0] for e in entries if e[0] and covers(e[0], u)}:
                before = [(t, a) for q, t, a in entries if q == p and t and t <= at]
                if before:
                    t = max(x for x, _ in before)
                    best = max(best or (0,), (len(p), p, t, min(a for x, a in before if x == t)))
        want.append((u, at, *(best[1:] if best else (None,) * 3)))
    got = evaluate(df.withColumnRenamed("start", "begin"), log)
    same([(r.url, r.fetched, r.pattern, r.since, r.action) for r in got.collect()], want)
    assert sum(w[2] is not None for w in want) > 20
    assert evaluate(df.limit(0).withColumnRenamed("start", "begin"), log).count() == 0
    assert evaluate(df, log.limit(0)).where("action IS NOT NULL").count() == 0
    clashing = df.withColumns({c: F.lit("x") for c in ("best", "pattern", "since", "action", "slot", "slots", "period", "end", "path")})
    got = evaluate(clashing, log)
    same([(r.url, r.fetched, r.pattern, r.since, r.action) for r in got.collect()], want)
    assert len(set(got.columns)) == len(got.columns) and {r.best for r in got.collect()} == {"x"}


def test_url_filter_with_a_hot_host(spark):
    """One host with 20,000 entries and as many captures in a week, evenly spread and all within a minute."""
    base, rng = datetime(2024, 1, 1), random.Random(4)
    for step in (28_000_000, 3_000):  # microseconds
        entries = [("hot.org", base + timedelta(microseconds=k * step), f"a{k}") for k in range(20_000 if step > 3_000 else 3_000)]
        captures = [(k, "http://hot.org/x", base + timedelta(microseconds=rng.randrange(len(entries) * step))) for k in range(len(entries))]
        got = evaluate(spark.createDataFrame(captures, "id long, url string, fetched timestamp"),
                       spark.createDataFrame(entries, "pattern string, ts timestamp, action string"))
        want = [(k, f"a{(at - base) // timedelta(microseconds=step)}") for k, _, at in captures]
        same([(r.id, r.action) for r in got.collect()], want)


# --- 3 ------------------------------------------------------------------------------------------


def brute_ctw(texts: list[tuple[bool, bytes]], depth: int) -> list[float]:
    """Context-tree weighting with plain dictionaries; texts: (in training, coded bytes)."""
    counts: dict = defaultdict(lambda: [0, 0])

    def places(data):
        padded = lm_score.END * depth + data
        for k, x in enumerate(data):
            context = padded[k:k + depth][::-1]
            for b in range(8):
                yield context, (1 << b) | (x >> (8 - b)), (x >> (7 - b)) & 1

    for train, data in texts:
        for context, node, bit in places(data) if train else ():
            for d in range(depth + 1):
                counts[context[:d], node][bit] += 1
    kt = lambda z, o: math.lgamma(z + .5) + math.lgamma(o + .5) - math.lgamma(z + o + 1) - math.log(math.pi)
    below: dict = defaultdict(float)
    share = {}
    for (c, node), (z, o) in sorted(counts.items(), key=lambda x: -len(x[0][0])):
        own = kt(z, o)
        if len(c) == depth:
            share[c, node], weighted = 1.0, own
        else:
            share[c, node] = 1 / (1 + math.exp(min(700, below[c, node] - own)))
            weighted = np.logaddexp(own, below[c, node]) - math.log(2)
        if c:
            below[c[:-1], node] += weighted
    out = []
    for _, data in texts:
        total = 0.0
        for context, node, bit in places(data):
            rest, done, last = 1.0, 0.0, 0.5
            for d in range(depth + 1):
                n = counts.get((context[:d], node))
                if n is None:
                    if d == 0:
                        rest, done = 0.5, 0.25
                    break
                last = (n[1] + .5) / (sum(n) + 1)
                done, rest = done + rest * share[context[:d], node] * last, rest * (1 - share[context[:d], node])
            one = done + rest * last
            total += math.log10(one if bit else 1 - one)
        out.append(total)
    return out


def test_lm_scores(docs, empty):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.held_out, r.base_score, r.score)
                 for r in lm_scores(docs, depth=3, block_bytes=4000).collect())
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in TEXTS]
    coded = [lm_score.coded(t) for _, t in TEXTS]
    tokens = [[*w, lm_score.END] for w, _ in coded]
    c = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    ctw = brute_ctw([(not h, d) for h, (_, d) in zip(held, coded, strict=True)], 3)
    want = sorted((i is not None, i or 0, len(w), sum(c[x] > 0 for x in w), n, h, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), s)
                  for (i, _), w, h, s in zip(TEXTS, tokens, held, ctw, strict=True))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:6] == w[:6]
        assert g[6:] == pytest.approx(w[6:], rel=1e-9)
    assert lm_scores(empty).count() == 0


def test_lm_predictions_are_probabilities():
    """Over all 256 bytes after one context, seen or not, the chances sum to 1."""
    rng = np.random.default_rng(3)
    data = bytes(rng.integers(97, 103, 4000, dtype=np.uint8)) + b"zq"
    key, n = np.unique(lm_score.grams([data], 4), return_counts=True)
    for context in (data[100:104][::-1], b"zzzz", b"azzz", data[50:52][::-1] + b"\xff\xff"):
        asked = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)], np.uint64)
        keys = np.union1d(key, asked)
        counts = np.zeros(len(keys), np.int64)
        counts[np.searchsorted(keys, key)] = n
        tops: dict = defaultdict(lambda: {"zeros": 0.0, "ones": 0.0, "weighted": 0.0})
        tree = lm_score.Tree(keys, counts, 4, 2)
        for i, z, o, w in zip(tree.ids, tree.zeros, tree.ones, tree.weighted, strict=True):
            row = tops[((int(i) >> 16) << 8) | (int(i) & 255)]
            row["zeros"], row["ones"], row["weighted"] = row["zeros"] + z, row["ones"] + o, row["weighted"] + w
        value = tree.log10(*lm_score._top_of_trees([{"slot": k, **r} for k, r in tops.items()]))
        assert (10 ** value[np.searchsorted(keys, asked)]).sum() == pytest.approx(1)


def test_log_gamma():
    x = np.concatenate([np.arange(0.5, 40, 0.5), [1e4 + 0.5, 1e9 + 0.5]])
    assert lm_score.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-10)


# --- 4 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size, windows, parts", [(64, 4, 3), (4096, 64, 3), (64, 2, 40)])
def test_packing_round_trip(docs, empty, size, windows, parts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = pack(docs.repartition(parts), tokenizer_path(), end_id=2, size=size, windows=windows, min_cut=8).collect()
    want = Counter()
    for i, t in TEXTS:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.update((i, k, int(x)) for k, x in enumerate(ids))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sum(r.length for r in rows) == sum(want.values())
    texts = defaultdict(list)
    for i, t in TEXTS:
        texts[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    for i, pieces in by_doc.items():
        for p in pieces:
            assert p.ids_crc32 in {zlib.crc32(ids[p.start:p.start + p.length].tobytes()) for ids in texts[i] if len(ids) == p.doc_tokens}
        assert sum(p.length for p in pieces) == sum(map(len, texts[i]))
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    if windows == 4:
        assert 1 - sum(r.length for r in rows) / (size * len(by_sequence)) < 0.15
    assert pack(empty, tokenizer_path(), 2).count() == 0


def test_words_of_a_text_tokenize_as_the_text():
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(tokenizer_path()), packing.WordTokenizer(tokenizer_path())
    for text in ("It's 12kg!! ΟΔΟΣ ΟΔΟΣ. é ́x  a b c\x1cd", "<|endoftext|>x <|start of", "I'M 'll ' ll ﬁn İstanbul\x85y", "日本語 テスト\n\n\tعربى"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_new_words_share_their_pieces():
    """Case and punctuation make no new pieces, and the ids are those of the whole text."""
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(tokenizer_path()), packing.WordTokenizer(tokenizer_path())
    rng = random.Random(5)
    parts = ["haus", "STRASSE", "straße", "Éçai", "œuvre", "ŸÿŽ", "ıİ", "ǅǆ", "ʯʰ", "x×y÷", "'s", "'T", "''re", "'LL'd", "'", "12", "3", "²", "½", "ª", "º", "µ", "_", "-", "|", "<|", "|>",
             "<|startoftext|>", "“", "”", "…", "–", "«", "»", "e\u0301", "T\u0308", "\u00a0", "\u0085", "Σ", "ς", "日本", "#", "...", "\x7f", "\x1c", "\x00"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(3000)]
    text = " ".join(words)
    for _ in range(2):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    asked = []
    own = packing.WordTokenizer(tokenizer_path())
    ids, own._ids = own._ids, lambda tokenizer, texts: asked.extend(texts) or ids(tokenizer, texts)
    own.encode("Haus haus, HAUS! (haus) haus")
    own.encode("haus? HAus,")
    assert sorted(" ".join(asked).split()) == sorted(["haus", ",", "!", "(", ")", "?"])


# --- 5 and 9 ------------------------------------------------------------------------------------


def cover(n, places, length):
    mask = bytearray(n)
    for k in places:
        mask[k:k + length] = b"\1" * length
    return mask


@pytest.mark.parametrize("block_bytes", [1500, 1 << 20])
def test_repeated_bytes(docs, empty, block_bytes, monkeypatch):
    monkeypatch.setattr(blocks.Blocks.__init__, "__defaults__", (block_bytes,))
    data = [(math.inf if i is None else i, i, (t or "").encode()) for i, t in TEXTS]
    least: dict[bytes, float] = {}
    for i, _, b in data:
        for k in range(len(b) - 49):
            least[b[k:k + 50]] = min(i, least.get(b[k:k + 50], math.inf))
    want = []
    for i, own, b in data:
        mask = cover(len(b), [k for k in range(len(b) - 49) if least[b[k:k + 50]] < i], 50)
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        spans = [(m.start(), len(m[0])) for m in re.finditer(b"\1+", bytes(mask))]
        want.append((own, len(b), sum(mask), len(spans), hashlib.sha256(kept).hexdigest(), bytearray(kept), spans))
    got = [(*r[:5], r.kept, [tuple(s) for s in r.spans]) for r in repeated_bytes(docs).collect()]
    same(got, want)
    assert sum(w[2] for w in want) > 500 and repeated_bytes(empty).count() == 0


@pytest.mark.parametrize("block_bytes", [1500, 1 << 20])
def test_repeated_words(docs, empty, block_bytes, monkeypatch):
    monkeypatch.setattr(blocks.Blocks.__init__, "__defaults__", (block_bytes,))
    all_words = [split_words(t) for _, t in TEXTS]
    count = Counter(tuple(w[k:k + 35]) for w in all_words for k in range(len(w) - 34))
    want = []
    for (i, _), w in zip(TEXTS, all_words, strict=True):
        mask = cover(len(w), [k for k in range(len(w) - 34) if count[tuple(w[k:k + 35])] > 1], 35)
        kept = " ".join(x for x, m in zip(w, mask, strict=True) if not m)
        spans = [(m.start(), len(m[0])) for m in re.finditer(b"\1+", bytes(mask))]
        want.append((i, len(w), sum(mask), hashlib.sha256(kept.encode()).hexdigest(), kept, spans))
    same([(*r[:5], [tuple(s) for s in r.spans]) for r in repeated_words(docs).collect()], want)
    assert sum(w[2] for w in want) > 300 and repeated_words(empty).count() == 0


def test_suffix_tuples_travel_as_bounded_runs():
    """A block's tuples are one row a range of the hash, the rows of a range hold all its tuples, and nothing else is in them."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, 3000).astype(np.uint8)).decode() for _ in range(40)] * 2
    runs = [suffix_dedup._grams(50, 7)(pa.table({"doc_id": list(range(k, 80, 4)), "text": texts[k::4], "block": pa.array([k] * 20, pa.int32())})) for k in range(4)]
    assert all(len(r) <= 7 for r in runs)
    both = pa.concat_tables(runs)
    sizes = [len(both.filter(pc.equal(both.column("range"), r)).column("key")) for r in range(7)]
    assert sizes == [4] * 7
    tuples = [sum(len(k) // 8 for k in both.filter(pc.equal(both.column("range"), r)).column("key").to_pylist()) for r in range(7)]
    assert max(tuples) < 1.3 * min(tuples)
    for r in range(7):
        part = both.filter(pc.equal(both.column("range"), r))
        key = np.concatenate([np.frombuffer(k, np.uint64) for k in part.column("key").to_pylist()])
        got = np.concatenate([np.frombuffer(k, np.uint64) for k in suffix_dedup._in_two_documents(part).column("key").to_pylist()])
        value, n = np.unique(key, return_counts=True)
        assert set(value[n > 1].tolist()) <= set(got.tolist()) <= set(value.tolist())


def test_windows_of_places_are_those_of_the_definition():
    rng = np.random.default_rng(4)
    s = suffix_dedup.Suffixes([bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (300, 0, 49, 50, 1, 700)], 50)
    ends = np.concatenate([[hi] * (hi - lo) for lo, hi in zip(s.starts[:-1], s.starts[1:], strict=True)])
    assert s.valid.tolist() == [k + 50 <= ends[k] for k in range(len(s.valid))]
    at = s.sampled()
    assert s.doc(at).tolist() == [max(i for i in range(6) if s.starts[i] <= p) for p in at]
    some = at[::3]
    want = [w for w in range(len(s.low)) if s.valid[w] and any(w <= p <= w + s.reach and s.order[p] == s.low[w] for p in some)]
    assert s.windows_of(some).tolist() == want


def test_sampled_places_cover_every_window():
    rng = np.random.default_rng(1)
    gram = rng.integers(1, 50, 5000).astype(np.uint64)  # many ties
    low = blocks.sliding(gram, 9)
    assert (low == np.lib.stride_tricks.sliding_window_view(gram, 9).min(axis=1)).all()
    valid = rng.random(len(low)) < 0.8
    want = {p for i in np.flatnonzero(valid) for p in range(i, i + 9) if gram[p] == low[i]}
    assert want <= set(blocks.sampled(gram, low, valid, 9).tolist())


# --- 6 ------------------------------------------------------------------------------------------


def test_main_text(spark):
    pages = [(1, None, None), (2, "http://a/", ""), (3, "http://a/", "no markup &amp; one &lt;b&gt;"),
             (4, "http://a/", "<nav>menu</nav><article><h1>T</h1><p>x <b>y</b>z<br>w<aside>no</aside><script>'</p>'</script><p>&#233;\n\t e</article><footer>f"),
             (5, "http://a/", "<article><p>a</p><div class='ad x'>no</div><section id=comments><p>no</p></section><form>no</form></article><p>out"),
             (6, "http://a/", "<title>no</title><div>k <!-- c > d --> l</div><p title='>'>m<a href=\"open>n"),
             (7, "http://a/", "<main></main><p>other"), (4, "http://a/", "<p>same id"),
             (8, "http://b/", "<div class='no-sidebar content'><p>whole article</p></div>"), (9, "http://c/", "<div class='related-work'><p>a section</p></div>"),
             (10, "http://d/", "<article><div class='entry-header'><h1>Title</h1></div><p>t</p><div class='cookie-banner'>no</div></article>"),
             (11, "http://e/", "<p>see <a class='share'>our story</a> now<div id=site_footer>no</div>")]
    texts = {1: [""], 2: [""], 3: ["no markup & one <b>"], 4: ["T x yz w é e", "same id"], 5: ["a"], 6: ["k l mn"], 7: ["other"],
             8: ["whole article"], 9: ["a section"], 10: ["Title t"], 11: ["see our story now"]}
    same_everywhere = "<div class=top>Site of all</div>"
    pages += [(100 + k, "http://big.org/%d" % k, f"{same_everywhere}<div class=body><p>Text {k}</p><p>and {k * k}</p></div><div class=legal><p>All rights</p></div>") for k in range(40)]
    texts |= {100 + k: [f"Text {k} and {k * k}"] for k in range(40)}
    df = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, text string")
    got = main_text(df).collect()
    same([(r.page_id, r.text) for r in got], [(i, t) for i, ts in texts.items() for t in ts])
    assert all(r.n_chars == len(r.text) for r in got)
    assert {(r.page_id, r.url) for r in got} == {p[:2] for p in pages}
    assert main_text(df.limit(0)).count() == 0


def test_copies_of_a_page_are_one_page(spark):
    """A third of a host's pages are one page: its text stays, what stands on every page goes."""
    bar, legal = "<div class=top>Site of all</div>", "<div class=legal><p>All rights</p></div>"
    pages = [(k, "http://h/%d" % k, f"{bar}<div class=body><p>Text {max(k, 300)}</p><p>and {max(k, 300) ** 2}</p></div>{legal}") for k in range(900)]
    got = main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    same([(r.page_id, r.text) for r in got], [(k, f"Text {max(k, 300)} and {max(k, 300) ** 2}") for k in range(900)])


def test_the_tree_reads_articles_too(spark):
    """What stands in nearly all articles of a host goes, what half of them share stays, and no article goes as a whole."""
    tail = "<div class=tail><p>Read us every day</p></div>"
    pages = [(k, "http://h/%d" % k, f"<article><h1>Title {k}</h1><p>Half {k % 2}</p><p>Text {k}</p>{tail}</article>") for k in range(100)]
    pages += [(100 + k, "http://few/%d" % k, f"<article><p>Text {k}</p>{tail}</article>") for k in range(10)]
    pages += [(200 + k, "http://gone/%d" % k, f"<div>Part {k}</div><article><p>No such page</p></article>") for k in range(100)]
    want = [(k, f"Title {k} Half {k % 2} Text {k}") for k in range(100)] + [(100 + k, f"Text {k} Read us every day") for k in range(10)]
    want += [(200 + k, "No such page") for k in range(100)]
    same([(r.page_id, r.text) for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()], want)


def test_an_element_of_few_shapes_keeps_its_texts(spark):
    """Nearly all pages have the same sequence of children, but what stands in them differs."""
    parts = lambda k: 1 if k < 850 else k - 850 + 2
    pages = [(k, "http://h/%d" % k, "<div class=body>" + "".join(f"<p>Text {k} {j}</p>" for j in range(parts(k))) + "</div>") for k in range(900)]
    got = main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    same([(r.page_id, r.text) for r in got], [(k, " ".join(f"Text {k} {j}" for j in range(parts(k)))) for k in range(900)])


@pytest.mark.parametrize("page", ["<b>" * 60_000 + "x", "<div>" * 60_000 + "x" + "</section>" * 60_000,
                                  "<i><p>" + "<b>" * 30_000 + "x</i>" * 30_000, "<div>" * 30_000 + "<p>x" * 30_000])
def test_deep_pages_are_linear(page):
    started = time.process_time()
    assert "x" in html_extract.Page(page).blocks[0][1]
    assert time.process_time() - started < 5


def test_main_text_is_linear_in_broken_pages(spark):
    page = "<p class='" * 20_000 + "<div" * 20_000 + "<!--" * 20_000
    assert main_text(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).count() == 1


# --- 7 ------------------------------------------------------------------------------------------


def test_quality_base(docs, empty):
    want = []
    for i, t in TEXTS:
        w, t = split_words(t), t or ""
        three = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        c = Counter(three)
        repeat = sum(cover(len(w), [k for k, g in enumerate(three) if c[g] > 1], 3))
        lines = [x for x in t.split("\n") if split_words(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, len(w) < 50 or 100 * repeat > 50 * len(w)))
    got = quality_scores(docs).collect()
    same([tuple(r)[:7] for r in got], want)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_scores(empty).count() == 0 and keep_quality(empty).count() == 0
    left = keep_quality(docs)
    assert left.columns == docs.columns
    same([(r.doc_id,) for r in left.collect()], [(r.doc_id,) for r in got if r.kept])


def test_quality_separates_junk(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(["the", "of", "house", "river", "walks", "and", "a", "yellow", "is", "to"] + [f"word{k}" for k in range(50)]) for _ in range(n))
    clean = [(k, prose(150)) for k in range(60)]
    junk = [(100 + k, prose(100).upper().replace(" ", "!! ")) for k in range(8)] + [(200 + k, " | ".join(f"zz{rng.random()}" for _ in range(80))) for k in range(8)]
    junk += [(300 + k, "".join(f"{x}{rng.choice(['%%%', '###', '$$$'])} " for x in prose(90).split())) for k in range(8)]
    got = {r.doc_id: r.kept for r in quality_scores(spark.createDataFrame(clean + junk, "doc_id long, text string")).collect()}
    assert all(got[i] for i, _ in clean) and not any(got[i] for i, _ in junk)


def test_vote_model():
    """Planted accuracies come back, and the classes keep their sides."""
    rng = random.Random(4)
    accuracy = [0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.7, 0.95]
    counts: Counter = Counter()
    truth = defaultdict(lambda: [0, 0])
    for _ in range(40_000):
        text = rng.random() < 0.8
        p = "".join("0" if rng.random() < 0.2 else "+-"[text != (rng.random() < a)] for a in accuracy)
        counts[p] += 1
        truth[p][text] += 1
    model = quality.fit_votes(dict(counts))
    assert model.prior == pytest.approx(0.8, abs=0.02)
    assert list(model.accuracy().values()) == pytest.approx(accuracy, abs=0.03)
    right = sum(truth[p][model.posterior(p) >= 0.5] for p in counts)
    assert right / 40_000 > 0.96
    assert 0 < quality.fit_votes({}).posterior("+" * 8) < 1


# --- 8 ------------------------------------------------------------------------------------------


def test_leaks(spark, docs, empty):
    item = "A train leaves the old station with 12 cars and goes 30 km to the town where Anna waits for it on the bridge"
    other = "Seven small birds sat on the fence near the river and sang until the evening came over the hills"
    schema = "item_id long, text string"
    bench = spark.createDataFrame([(1, item), (2, other), (3, "too short"), (4, None), (2, other), (None, "nothing like this text is to be found in any of the documents here")], schema)
    changed = item.replace("12", "15").replace("30", "45").replace("Anna", "Berta")
    mixed = item + " " + " ".join(item.split()[:14]).replace("12", "99")
    rows = [(1, "before it. " + item + " and after"), (2, changed), (3, other.upper()), (4, " ".join(other.split()[:9])), (5, None), (6, ""), (7, mixed),
            (8, "clean text of more than eight words that says something else entirely"), (1, "before it. " + item + " and after"), (None, other)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id): (r.n_matched == r.n_windows, r.n_changed) for r in leaks(df, bench).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, 1): True, (2, 1): True, (7, 1): True, (None, 2): True, (3, 2): True}
    assert got[1, 1][1] == 0 and got[2, 1][1] == 3
    left = drop_leaks(df, bench)
    assert left.columns == df.columns
    assert {4, 5, 6, 8} <= {r.doc_id for r in left.collect()} and not {1, 2, 7, None} & {r.doc_id for r in left.collect()}
    assert leaks(docs, bench).count() == 0 and leaks(empty, bench).count() == 0 and leaks(df, bench.limit(0)).count() == 0


def test_leaks_in_other_case(spark):
    """Words as they are count where names are typed by case: upper, lower, without full stops, and items in capitals."""
    named = "Old Anna Meyer met the tall guide at Lake Como. Then Berta Lang rowed them over to Bellagio before the storm came"
    plain = "Seven small birds sat on the fence near the river and sang until the evening came over the hills"
    loud = "WHO TOOK THE LAST TRAIN FROM THE NORTHERN STATION TO THE SEA"
    bench = spark.createDataFrame([(1, named), (2, plain), (3, loud)], "item_id long, text string")
    rows = [(1, named.upper()), (2, plain.upper()), (3, named.lower()), (4, named.replace(".", " ,")), (5, loud.title()), (6, "so " + loud + " now"),
            (7, " ".join(plain.upper().split()[:9])), (8, "Other words " * 9), (None, plain.title())]
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_windows, r.n_changed) for r in leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 1), (4, 1), (5, 3), (6, 3), (None, 2)}
    assert all(matched == n and not changed for matched, n, changed in got.values())
    assert got[2, 2][1] == len(plain.split()) - 7 and got[5, 3][1] == len(loud.split()) - 7


@pytest.mark.parametrize("odd", [False, True])
def test_anchors_find_what_all_windows_find(spark, monkeypatch, odd):
    """Words meet anchors before windows are hashed; every window has one, or all windows are hashed."""
    rng = random.Random(8)
    parts = ["a", "The", "old", "river", "Anna", "12", "km", "30%", "Berta.", "!", "went,", "to", "sea?", "house", "ΣΑΣ", "x.y", "<n>", "Zug"]
    items = [" ".join(rng.choices(parts, k=rng.randint(5, 30))) for _ in range(30)] + ([". ! ? . ! ? . ! ? . !"] if odd else ["THE OLD RIVER WENT TO SEA AND HOUSE BY ZUG"])
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 40))) + " " + rng.choice(items) + rng.choice([" ", ". "]) + " ".join(rng.choices(parts, k=9)) for _ in range(150)]
    texts += [t.upper() for t in texts[:20]] + [t.replace("12", "13").replace("Anna", "Clara") for t in texts[20:60]] + [items[0], items[1] + " end", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    known = decontam.templates(bench).cache()
    assert (decontam._anchors(known, "h") is None) == odd and decontam._anchors(known, "g") is not None
    got = sorted(tuple(r) for r in leaks(docs, bench).collect())
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert decontam._anchors(known, "g") is None
    assert got == sorted(tuple(r) for r in leaks(docs, bench).collect()) and len(got) > 150


def test_leaks_with_one_value_for_two(spark):
    """Equal slot values that stand for two values cost their windows, not the alignment."""
    sum_of = "Add 2 apples and 2 pears to the basket that stands behind the door of the kitchen and count what lies in it"
    names = "Yesterday Anna walked along the river with her dog and told everyone in the village that nobody but Anna had seen it"
    bench = spark.createDataFrame([(1, sum_of), (2, names)], "item_id long, text string")
    rows = [(1, sum_of.replace("2", "3", 1).replace("2", "4")), (2, names.replace("but Anna", "but Berta")), (3, sum_of.replace("2", "3")), (4, names.replace("Anna", "Berta"))]
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_windows, r.n_changed) for r in leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    n, m = len(sum_of.split()) - 7, len(names.split()) - 7
    # Document 1: the windows 0 and 1 hold both numbers, 2 to 4 the second only. Document 2: four windows have Berta, and those with Anna are literal.
    assert got == {(1, 1): (n - 2, n, 1), (2, 2): (m, m, 1), (3, 1): (n, n, 1), (4, 2): (m, m, 1)}


@pytest.mark.parametrize("broadcast_rows", [None, 0])
def test_leaks_store_windows_and_not_documents(spark, monkeypatch, broadcast_rows):
    """Spark reads 4096 rows of a table at once, so rows on the way must not grow with the documents; two texts share an id."""
    item = "A train leaves the old station with 12 cars and goes 30 km to the town where Anna waits for it"
    prose = " ".join(f"w{k}" for k in range(3000))
    rows = [(1, f"{prose}. {item}. {prose}"), (1, item.replace("12", "15")), (2, f"{item.replace('30', '45')} {prose}"), (None, f"{prose} {item}"), (3, prose)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    longest, save = {}, Scratch.save

    def saved(self, df, name, *more):
        out = save(self, df, name, *more)
        arrays = [F.max(F.size(c)) for c, kind in out.dtypes if kind.startswith("array")]
        longest[name] = max(n or 0 for n in out.agg(F.lit(0), *arrays).first())
        return out

    monkeypatch.setattr(Scratch, "save", saved)
    if broadcast_rows is not None:
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", broadcast_rows)
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_windows, r.n_changed) for r in leaks(docs, bench).collect()}
    n = len(item.split()) - 7
    assert got == {(1, 7): (n, n, 1), (2, 7): (n, n, 1), (None, 7): (n, n, 0)}
    # The windows of both texts of document 1 are the longest list.
    assert "found" in longest and max(longest.values()) <= max(2 * decontam.WINDOW, 2 * n)


# --- 10 -----------------------------------------------------------------------------------------


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in split_words(t)]
        sets.append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    members = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        members[find(x)].append(i)
    return [(i, len(sets[x]), min((m for m in members[find(x)] if m is not None), default=None) if sets[x] else i) for x, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("k, percent, cell", [(4, 85, 512), (5, 80, 2), (1, 50, 2), (2, 60, 3)])
def test_jaccard_components(docs, empty, k, percent, cell, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL", cell)
    want = brute_components(TEXTS, k, percent)
    same([tuple(r) for r in jaccard_components(docs, k, percent).collect()], want)
    assert jaccard_components(empty).count() == 0
    left = keep_one(docs, k, percent)
    assert left.columns == docs.columns
    same([(r.doc_id,) for r in left.collect()], [(i,) for i, _, c in want if i is None or c == i])


def test_jaccard_random_sets(spark):
    """Many partly shared sets, so that tiles hold several components and cells are compared."""
    rng = random.Random(8)
    rows = []
    for base in range(6):
        words = [f"b{base}w{j}" for j in range(40)]
        for _ in range(20):
            w = list(words)
            for _ in range(rng.randint(0, 14)):
                w[rng.randrange(40)] = f"r{rng.randrange(30)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (60, 75, 90):
        same([tuple(r) for r in jaccard_components(df, 1, percent).collect()], brute_components(rows, 1, percent))


def test_linked_sets_share_a_tile():
    """Pairs at the very edge of the bound, of all sizes, also the smallest."""
    rng = np.random.default_rng(9)
    for percent in (50, 80, 85, 95):
        for _ in range(3000):
            n = int(rng.choice([rng.integers(1, 12), rng.integers(12, 90), rng.integers(90, 400)]))
            pool = np.unique(rng.integers(0, 1 << 63, 3 * n + 9).astype(np.uint64))
            m = int(rng.integers(max(1, percent * n // 100), n + 1))
            common = int(np.ceil(percent * (n + m) / (100 + percent)))  # the least intersection that links
            if common > m:
                continue
            rng.shuffle(pool)
            x, y = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n:n + m - common]]))
            assert jaccard.linked(common, n, m, percent)
            assert np.isin(jaccard.tile_keys(x, percent), jaccard.tile_keys(y, percent)).any()


def test_bit_bound_is_an_upper_bound():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (5, 9), (300, 280), (900, 2000)):
        pool = rng.integers(0, 1 << 62, n + m).astype(np.uint64)
        x, y = np.unique(rng.choice(pool, n)), np.unique(rng.choice(pool, m))
        a, b = (np.frombuffer(jaccard.signature(s), np.uint8)[None, :] for s in (x, y))
        size = min(a.shape[1], b.shape[1])
        bound = jaccard.bit_bound(jaccard.fold(a, size), jaccard.fold(b, size), len(x), len(y))[0]
        assert len(np.intersect1d(x, y)) <= bound <= min(len(x), len(y))


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()
    same([tuple(r) for r in got], [(x, find(x)) for x in root])
