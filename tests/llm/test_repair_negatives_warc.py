"""Conversation repair, hard negatives and capture archives against brute force, with hard cases."""

from __future__ import annotations

import base64
import functools
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from itemweave.llm import conversation_repair as cr
from itemweave.llm import hard_negatives as hn
from itemweave.llm import warc
from itemweave.llm.hard_negatives import hard_negatives

# --- conversations -----------------------------------------------------------------------------------------------------

CONVERSATIONS = "conv_id long, turn long, role string, text string, part int, no string, copies long, later string, piece int, digest string, lo int"


def best_edits(rows):
    """(cost, audit) by dynamic programming over single rows (initial of the role, fault)."""
    @functools.lru_cache(None)
    def go(i, state, inserts):
        found = [(0, "")] if i == len(rows) and state in cr.FINAL else []
        if inserts < 3:
            found += [(c + 3, "I" + a) for c, a in [go(i, cr.NEXT[state], inserts + 1)] if c is not None]
        if i < len(rows):
            initial, fault = rows[i]
            ways = [(4, "D", state)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ways.append((3 + more, "R", cr.NEXT[state]))
                if (state, initial) in cr.KEPT:
                    ways.append((more, "K", cr.KEPT[state, initial]))
            found += [(cost + c, e + a) for cost, e, to in ways for c, a in [go(i + 1, to, 0)] if c is not None]
        return min(found, default=(None, ""))
    for i in range(len(rows), 0, -1):  # from the end, or long conversations go too deep
        for state in range(4):
            go(i, state, 0)
    return go(0, 0, 0)


def repaired(rows):
    """Every figure of one conversation from its (turn, role, text) rows."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    cost, audit = best_edits(tuple((r[1][:1], f) for r, f in zip(rows, faults, strict=True)))
    turns = {r[0] for r in rows if r[0] is not None}
    state, at, left = 0, 0, []
    for edit in audit:
        if edit == "I":
            state = cr.NEXT[state]
            left.append(cr.ROLE[state] + ":")
            continue
        _, role, text = rows[at]
        at += 1
        if edit == "K":
            state = cr.KEPT[state, role[0]]
            left.append(f"{role}:{text}")
        elif edit == "R":
            state = cr.NEXT[state]
            left.append(f"{cr.ROLE[state]}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in left))
    return {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(left).encode()).hexdigest()}


def conversations():
    rng = random.Random(3)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool"])
            text = rng.choice([f"Says {rng.random()}.", f"Says {rng.random()}.", "Yes.", "Yes?", "no end", " \t\n\x0b\x0c\r ", "", None, "Ends! \n"])
            rows.append((conv, rng.choice([turn, turn, 2 * turn, None, 5]), role, text))
    rows += [(50, 1, "user", "Same."), (50, 1, "assistant", "Same.")] * 3  # repeated rows, ties
    rows += [(51, k // 2, rng.choice(["user", "assistant"]), rng.choice([f"Long {k}.", f"cut {k}", "Again.", ""])) for k in range(300)]
    rows += [(52, 7, "user", f"Of one turn {k}.") for k in range(60)]
    rows += [(53, 1, "user", "x" * 200_000), (53, 2, "assistant", "y" * 200_000 + ".")]
    rows += [(54, 2**40, "system", "Far."), (54, -5, "user", "Before.")]
    return rows


@pytest.mark.parametrize("block_rows", [4, 512])
def test_repair_is_cheapest(spark, block_rows):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "n", 2, "l", 3, "d", 4) for r in rows], CONVERSATIONS).repartition(3)
    got = {r["conv_id"]: r.asDict() for r in cr.digests(cr.repair(df, block_rows=block_rows)).collect()}
    want = defaultdict(list)
    for conv, *row in rows:
        want[conv].append(row)
    assert set(got) == set(want)
    for conv, own in want.items():
        row = got[conv]
        del row["conv_id"]
        assert row == repaired(own), conv


def test_two_heaps_find_the_least_audit():
    rng = random.Random(1)
    for _ in range(1500):
        steps = [(rng.choice("suaux"), rng.choice(["", "", "", "blank", "duplicate", "truncated"]), rng.choice([1, 1, 1, 2, 3])) for _ in range(rng.randint(0, 8))]
        single = [(i, f if k == 0 or f == "blank" else "duplicate") for i, f, n in steps for k in range(n)]
        assert cr.cheapest(steps, cr.START, cr.FINAL, True) == best_edits(tuple(single))


def test_pieces_hold_the_turns(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(20)]
    pieces = cr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block_rows=6).orderBy("piece").collect()
    assert len(pieces) >= 4 and max(len(p["repaired"]) for p in pieces) <= 6
    assert [t["text"] for p in pieces for t in p["repaired"]] == [r[3] for r in rows]


def test_damaged_conversations(spark):
    rows = conversations()[:150]
    df = spark.createDataFrame([(*r, 1, "n", 2, "l", 3, "d", 4) for r in rows], CONVERSATIONS)
    left = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        left[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = {r["conv_id"]: r.asDict() for r in cr.repaired_digests(df).collect()}
    assert set(got) == set(left)
    for conv, own in left.items():
        row = got[conv]
        del row["conv_id"]
        assert row == repaired(own), conv
    assert cr.repaired_digests(df.limit(0)).count() == 0


# --- hard negatives ----------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, part int, `set` int, vector string, summary string, anchor_id long"


def mined(rows, anchor, scale=256.0):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x * scale) for x in v):
            continue
        whole = [math.floor(x * scale) for x in v]
        kept[i] = min(kept.get(i, (label, whole)), (label, whole))
    out = []
    for a, (label, v) in kept.items():
        if anchor(a):
            scores = {i: sum(x * y for x, y in zip(v, w, strict=False)) for i, (_, w) in kept.items() if i != a}
            ranked = sorted(scores, key=lambda i: (-scores[i], i))
            for p in [i for i in ranked if kept[i][0] == label][:5]:
                fits = [i for i in ranked if kept[i][0] != label and 50 * scores[p] <= 100 * scores[i] <= 95 * scores[p]]
                out += [(a, p, k + 1, n, scores[p], scores[n]) for k, n in enumerate(fits[:3])]
    return sorted(out)


def vectors():
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 0.2) + 0.1 for _ in range(20)], rng.randrange(4)) for k in range(300)]
    rows += [(k, rows[7][1], 1) for k in range(300, 420)]  # one vector, ties by id
    rows += [(k, rows[7][1], 2) for k in range(420, 440)]
    rows += [(500, None, 1), (501, [0.1, None], 1), (502, [math.nan] * 20, 1), (503, [math.inf] * 20, 1), (504, [0.1] * 20, None), (None, [0.1] * 20, 1)]
    rows += [(505, [], 1), (510, [0.5, 0.5], 2), (520, [0.25] * 25, 3), (530, [1e308] * 3, 1), rows[10], (11, [0.3] * 20, 0)]
    return rows


@pytest.mark.parametrize("slice_rows", [40, 32_768])
def test_hard_negatives(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(hn, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(hn, "ANCHOR_ROWS", 20)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, 2, "v", "s", 3) for r in rows], VECTORS).repartition(3)
    got = sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 10 == 0).collect())
    assert got == mined(rows, lambda i: i % 10 == 0)
    assert hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives(df, F.col("vec_id") < 0).count() == 0


def test_large_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(k, [float(rng.randrange(2**26)) for _ in range(6)], k % 2) for k in range(60)]
    got = sorted(tuple(r) for r in hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") < 9, scale=1.0).collect())
    assert got == mined(rows, lambda i: i < 9, 1.0)


def test_bounds_hold_at_every_level():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(50, 37)) * 100)
    table = pa.table({"vec_id": pa.array(range(50)), "label": pa.array([0] * 50), "vector": pa.array(list(x)), "summary": pa.array(list(hn.summary(x)))})
    v, rows = hn.Vectors(table, 37), np.arange(50)
    exact, width = x @ x.T, math.inf
    for level in range(len(hn.LEVELS)):
        middle, reach = v.bounds(level, rows, v, rows)
        assert (np.abs(exact - middle) <= reach).all()
        assert reach.sum() < width
        width = reach.sum()


# --- archives ----------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, key string, payload string, first long, digest string, size int, file string"


def pages():
    rows = [(k, f"http://www.host{k % 5}.example.org/p/{k}?q=a b#top", f"<html>\r\n\r\npage {k} é</html>") for k in range(60)]
    rows += [(k, "https://one.example.com/same", f"<p>{k % 3}</p>") for k in range(100, 140)]  # a key over many blocks, three payloads
    rows += [(200, None, None), (201, "", ""), (199, "no scheme", None), (None, "http://x.org/", "<p>0</p>"), (None, "http://x.org/", "only without id")]
    rows += [(202, "http://x.org/\r\nWARC-Type: response", "x" * 300_000), (203, "HTTP://U@X.org:80/A", "WARC/1.1\r\nContent-Length: 3\r\n\r\n")]
    rows += [rows[3], (3, "http://other.org/", rows[3][2]), (-4, "http://other.org/", rows[5][2])]
    return rows


def archived(rows, least=0):
    firsts = {}
    for i, _, h in rows:
        if i is not None:
            firsts[h or ""] = min(i, firsts.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = firsts.get(h or "") if len(data) >= least else i
        revisit = first is not None and first != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 9])
def test_archives_round_trip(spark, least):
    rows = pages()
    df = spark.createDataFrame([(*r, "k", "p", 1, "d", 2, "f") for r in rows], PAGES).repartition(3)
    archive = warc.write_index(warc.write_archives(df, least_bytes=least, roll_bytes=3_000), block_lines=4, shard_lines=10)
    assert archive.shards.count() > 5 and archive.shards.agg(F.sum("blocks")).first()[0] >= len(rows) // 4
    got = warc.fetch(archive, warc.find(archive, df)).collect()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == archived(rows, least)
    texts = {(i, h or "") for i, _, h in rows}
    for r in got:
        assert r["payload"] is None if r["record_type"] == "revisit" else (r["page_id"], bytes(r["payload"]).decode()) in texts


def test_files_are_archives(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame([(*r, "k", "p", 1, "d", 2, "f") for r in rows], PAGES).repartition(2)
    archive = warc.write_archives(df, folder=str(tmp_path / "a"))
    files = {r["file"]: r["n"] for r in archive.captures.groupBy("file").agg(F.sum("length").alias("n")).collect()}
    found = 0
    for name, size in files.items():
        path = Path(tmp_path / "a" / name)
        assert path.stat().st_size == size
        found += gzip.decompress(path.read_bytes()).count(b"WARC/1.1\r\nWARC-Type: re")
    assert found == len(rows)


def test_find_is_by_url(spark):
    df = spark.createDataFrame([(*r, "k", "p", 1, "d", 2, "f") for r in pages()], PAGES)
    archive = warc.write_index(warc.write_archives(df), block_lines=4, shard_lines=10)

    def ids(*urls):
        return sorted(r["page_id"] for r in warc.find(archive, spark.createDataFrame([(u,) for u in urls], "url string")).collect())

    assert ids("http://ONE.example.com./same#x", "https://one.example.com:443/same") == list(range(100, 140))
    assert ids("http://www.host2.example.org/p/7?q=a b") == [7]
    assert ids("http://www.host2.example.org/p", "http://zzz.org/", "http://a.aero/") == []
    assert ids(None) == [200, 201]
    keys = [r[0] for r in spark.createDataFrame([("http://www.a.org/x?y#z",), ("www.A.org.",), (None,)], "url string").select(warc.url_key(F.col("url"))).collect()]
    assert keys == ["org,a,www)/x?y", "org,a,www)", ""]


def test_empty_archive(spark):
    df = spark.createDataFrame([], PAGES)
    archive = warc.write_index(warc.write_archives(df))
    assert warc.fetch(archive, warc.find(archive, df)).count() == 0
