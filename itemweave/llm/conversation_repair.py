"""Repair of conversation structure by the cheapest edits.

The rows of a conversation, by turn, are edited until the initials of their roles match ``(s?(ua)+)?``: Keep costs 0, Rerole to
user or assistant 3, Delete 4, Insert of an empty user or assistant turn anywhere 3, and a truncated row that stays 3 more. Blank
and duplicate rows must be deleted. Nodes of the edit lattice are (rows done, role state); ``cheapest`` searches it from both ends:
a forward and a reverse heap grow until their least costs together exceed the best crossing, so that every crossing of equal cost is
known, and of these the least concatenated audit (the edits' initials D, I, K, R in ASCII order) wins.

Equal rows are counted before the shuffle and stay one step of the lattice (a copy can only be deleted, and D sorts first). The
counted rows are sorted by ranges of (conversation, turn, role, text), and each task cuts its range into blocks of at most
``BLOCK_ROWS`` steps. A conversation inside one block, nearly every one, is finished there. For one that is longer, or cut by the end
of a range, each block is searched between all pairs of role states. Inside a block an insert is followed by a row, so of two audits
over the same rows neither starts with the other; blocks therefore pass on their costs and the order of their audits only, in a row of
fixed size. These are chained, and each block then writes its own piece. No task holds more than a block's texts; the chaining holds
one short row for each ``BLOCK_ROWS`` rows of a conversation.

Defined cases: a NULL role or text counts as one space (so the text is blank); rows of one turn go by role, then text; NULL turns come
first and count for no gap; NULL is a conv_id like any other; further columns do not matter; empty tables give empty results. A role
whose initial is not s, u or a can be reroled or deleted only. Costs do not depend on a text's length. A rerole to a row's own role is
never cheapest. The audit of a conversation is as long as it has rows and inserts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemweave.llm.common import Scratch, small

BLOCK_ROWS = 512

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Role states: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind a kept row, by (state, initial of its role).
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state behind an inserted or reroled row: there is one role that fits each state.
NEXT = (USER, USER, ASSISTANT, USER)
FINAL = (START, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Inserts that end a conversation from each state.
CLOSING = ("", "II", "I", "")

COUNTS = ("blank", "duplicate", "truncated")
_REPAIRED = "array<struct<role:string,text:string>>"
_TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_BLOCK = ("conv_id {kind}, part int, no int, whole boolean, first_turn {turn}, last_turn {turn}, turns long, first_role string, last_role string, "
          "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired " + _REPAIRED + ", "
          "costs array<long>, ranks array<int>, rows array<struct<role:string,text:string,fault:string,copies:long>>")

Step = tuple[str, str, int]  # initial of the role, fault of the first copy ("" for none), copies


def moves(step: Step, state: int) -> Iterator[tuple[int, int, str]]:
    """(state behind the step, cost, audit) of every way to pass a step; copies after the first are always deleted."""
    initial, fault, copies = step
    rest, rest_cost = "D" * (copies - 1), DELETE * (copies - 1)
    yield state, DELETE + rest_cost, "D" + rest
    if fault not in ("blank", "duplicate"):
        extra = rest_cost + (TRUNCATED if fault == "truncated" else 0)
        if (state, initial) in KEPT:
            yield KEPT[state, initial], KEEP + extra, "K" + rest
        yield NEXT[state], REROLE + extra, "R" + rest


def cheapest(steps: list[Step], start: int, goals: Iterable[int], closing: bool) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits from ``start`` to one of ``goals``, or None if there are none.

    Free moves lead from one row to the next only. So with nodes of equal cost taken in the order of their rows (forward) or
    against it (reverse), a node's label is final when it leaves the heap. ``closing``: inserts may follow the last row.
    """
    n = len(steps)
    ahead = [[[(i + 1, t, c, a) for t, c, a in moves(step, s)] for s in range(4)] for i, step in enumerate(steps)]
    behind: list[list[list]] = [[[] for _ in range(4)] for _ in range(n + 1)]
    for i, by_state in enumerate(ahead):
        for s, out in enumerate(by_state):
            for _, t, c, a in out:
                behind[i + 1][t].append((i, s, c, a))
    for i in range(n + closing):
        for s in range(4):
            behind[i][NEXT[s]].append((i, s, INSERT, "I"))
            if i < n:
                ahead[i][s].append((i, NEXT[s], INSERT, "I"))
    ahead.append([[(n, NEXT[s], INSERT, "I")] if closing else [] for s in range(4)])
    labels = ({(0, start): (0, "")}, {(n, g): (0, "") for g in goals})
    heaps = ([(0, 0, start)], [(0, -n, g) for g in goals])
    final: tuple[set, set] = (set(), set())
    best = min((0 for node in labels[0] if node in labels[1]), default=None)
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        mine, other = labels[side], labels[1 - side]
        cost, at, s = heappop(heaps[side])
        node = (abs(at), s)
        if node in final[side]:
            continue
        final[side].add(node)
        audit = mine[node][1]
        for i, t, c, a in (behind if side else ahead)[node[0]][s]:
            label = (cost + c, a + audit if side else audit + a)
            if (i, t) not in mine or label < mine[i, t]:
                if (i, t) not in mine or label[0] < mine[i, t][0]:
                    heappush(heaps[side], (label[0], -i if side else i, t))
                mine[i, t] = label
                if (i, t) in other:
                    total = label[0] + other[i, t][0]
                    best = total if best is None else min(best, total)
    if best is None:
        return None
    return best, min(labels[0][v][1] + labels[1][v][1] for v in labels[0] if v in labels[1] and labels[0][v][0] + labels[1][v][0] == best)


def edited(audit: str, rows: list[tuple[str, str, str, int]], state: int) -> list[dict]:
    """The turns that an audit leaves of (role, text, fault, copies) rows."""
    out, row, copy = [], 0, 0
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            out.append({"role": ROLE[state], "text": ""})
            continue
        role, text, _, copies = rows[row]
        if edit == "K":
            state = KEPT[state, role[:1]]
            out.append({"role": role, "text": text})
        elif edit == "R":
            state = NEXT[state]
            out.append({"role": ROLE[state], "text": text})
        copy += 1
        if copy == copies:
            row, copy = row + 1, 0
    return out


def fault(text: str, later: bool) -> str:
    """The first fault of a row; ``later``: its role and text came before."""
    solid = text.rstrip(" \t\n\x0b\x0c\r")
    return "blank" if not solid else "duplicate" if later else "" if solid[-1] in ".!?" else "truncated"


def _matrix(steps: list[Step]) -> tuple[list[int], list[int]]:
    """Costs between all pairs of states (-1: no way), and the place of each audit among those from the same state."""
    costs, ranks = [], []
    for s in range(4):
        found = [cheapest(steps, s, [t], False) for t in range(4)]
        order = sorted(x[1] for x in found if x)
        costs += [x[0] if x else -1 for x in found]
        ranks += [order.index(x[1]) if x else -1 for x in found]
    return costs, ranks


def _block(conv_id, rows: list[tuple], part: int, no: int, whole: bool) -> dict:
    """rows: (turn, role, text, copies, later). Whole conversations are finished, others leave what chaining needs."""
    kept = [(role, text, fault(text, later), copies) for _, role, text, copies, later in rows]
    steps = [(role[:1], f, copies) for role, _, f, copies in kept]
    turns = [r[0] for r in rows if r[0] is not None]
    out = dict.fromkeys(("cost", "audit", "repaired", "costs", "ranks", "rows"))
    out |= {"conv_id": conv_id, "part": part, "no": no, "whole": whole, "turns": len(set(turns)),
            "first_turn": min(turns, default=None), "last_turn": max(turns, default=None),
            "first_role": steps[0][0], "last_role": steps[-1][0]}
    out |= {name: sum(c for _, f, c in steps if f == name) for name in ("blank", "duplicate")}
    out["duplicate"] += sum(c - 1 for _, f, c in steps if f in ("", "truncated"))
    out["truncated"] = sum(f == "truncated" for _, f, _ in steps)
    out["illegal"] = sum(c - 1 for i, _, c in steps if i + i not in LEGAL) + sum(a[0] + b[0] not in LEGAL for a, b in zip(steps, steps[1:], strict=False))
    if whole:
        out["cost"], out["audit"] = cheapest(steps, START, FINAL, True)
        out["repaired"] = edited(out["audit"], kept, START)
    else:
        out["costs"], out["ranks"] = _matrix(steps)
        out["rows"] = [dict(zip(("role", "text", "fault", "copies"), r, strict=True)) for r in kept]
    return out


def _blocks(block_rows: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, conv_id, rows, whole, begun = TaskContext.get().partitionId(), 0, None, [], False, False
        held: list[dict] = []
        for batch in batches:
            for conv, turn, role, text, copies, later in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "later")), strict=True):
                if not begun or conv != conv_id:
                    if rows:
                        held.append(_block(conv_id, rows, part, no, whole))
                        no += 1
                    # The first conversation of a range may have begun in the range before.
                    conv_id, rows, whole, begun = conv, [], begun, True
                elif len(rows) == block_rows:
                    held.append(_block(conv_id, rows, part, no, False))
                    no, rows, whole = no + 1, [], False
                rows.append((turn, role, text, copies, later))
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if rows:  # it may go on in the next range
            yield pa.RecordBatch.from_pylist([_block(conv_id, rows, part, no, False)], schema)
    return run


def _chain(schema: pa.Schema):
    """The states between the blocks of a conversation, and its totals."""
    def run(group: pa.Table) -> pa.Table:
        blocks = sorted(group.to_pylist(), key=lambda b: (b["part"], b["no"]))
        # From the end: the cheapest way on from each state before block k, and the state behind the block on it.
        cost = [INSERT * len(c) for c in CLOSING]
        ways = []
        for b in reversed(blocks):
            best = [min(((b["costs"][4 * s + t] + cost[t], b["ranks"][4 * s + t], t) for t in range(4)
                         if b["costs"][4 * s + t] >= 0 and cost[t] is not None), default=(None, 0, None)) for s in range(4)]
            ways.append([x[2] for x in best])
            cost = [x[0] for x in best]
        turned = [b for b in blocks if b["turns"]]
        gaps = 0
        if turned:
            shared = sum(a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:], strict=False))
            gaps = turned[-1]["last_turn"] - turned[0]["first_turn"] + 1 - sum(b["turns"] for b in turned) + shared
        illegal = sum(b["illegal"] for b in blocks) + sum(a["last_role"] + b["first_role"] not in LEGAL for a, b in zip(blocks, blocks[1:], strict=False))
        totals = {"gaps": gaps, "illegal": illegal, "cost": cost[START], "pieces": len(blocks)} | {c: sum(b[c] for b in blocks) for c in COUNTS}
        out, state = [], START
        for k, (b, way) in enumerate(zip(blocks, reversed(ways), strict=True)):
            out.append(totals | {"part": b["part"], "no": b["no"], "piece": k, "before": state, "behind": way[state]})
            state = way[state]
        return pa.Table.from_pylist(out, schema)
    return run


def _pieces(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                rows = [tuple(r[c] for c in ("role", "text", "fault", "copies")) for r in b.pop("rows")]
                last = b["piece"] == b["pieces"] - 1
                _, audit = cheapest([(role[:1], f, copies) for role, _, f, copies in rows], b["before"], [b["behind"]], False)
                audit += CLOSING[b["behind"]] * last
                out.append(b | {"audit": audit, "repaired": edited(audit, rows, b["before"])})
            if out:
                yield pa.RecordBatch.from_pylist([{c: o[c] for c in schema.names} for o in out], schema)
    return run


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The repaired conversations: conv_id, piece, pieces, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    A conversation of at most ``block_rows`` rows is mostly one row, a longer one a row for each piece of so many rows; the totals
    are those of the conversation and the same in all its pieces. ``repaired`` are the turns (role, text) that stay.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark)
    blank = F.lit(" ")
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text"))
    kind, turn_kind = rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    rows = scratch.save(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")), "rows")
    # Of equal turns at several places, NULL being the first, all but those at the first are duplicates.
    place = F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("turn"))
    digest = F.sha2("text", 256)
    again = (rows.groupBy("conv_id", "role", digest.alias("digest")).agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
             .where("lo < hi").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), "digest", "lo"))
    again = small(scratch.save(again, "again"))
    seen = rows.join(again, rows.conv_id.eqNullSafe(again.c) & (rows.role == again.r) & (digest == again.digest), "left")
    seen = seen.select(*rows.columns, F.coalesce(F.col("lo") < place, F.lit(False)).alias("later"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = (seen.repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, 32))
            .sortWithinPartitions("conv_id", "turn", "role", "text"))
    schema = _BLOCK.format(kind=kind, turn=turn_kind)
    blocks = scratch.save(laid.mapInArrow(_blocks(block_rows, _arrow(schema)), schema), "blocks")
    scratch.drop("rows", "again")
    out = ["conv_id", "piece", "pieces", "gaps", *COUNTS, "illegal", "cost", "audit", "repaired"]
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).cast("long")
    whole = blocks.where("whole").withColumns({"piece": F.lit(0).cast("long"), "pieces": F.lit(1).cast("long"), "gaps": gaps}).select(*out)
    cut = blocks.where("NOT whole")
    states = "part int, no int, piece long, pieces long, before int, behind int, " + _TOTALS
    # Only the states' side and the counts are chained; the texts stay where they are until their states are known.
    chained = scratch.save(cut.drop("rows", "audit", "repaired", "whole", "cost").groupBy("conv_id").applyInArrow(_chain(_arrow(states)), states), "states")
    texts = cut.select("conv_id", "part", "no", "rows").join(chained, ["part", "no"])
    pieces = f"conv_id {kind}, piece long, pieces long, {_TOTALS}, audit string, repaired {_REPAIRED}"
    done = texts.mapInArrow(_pieces(_arrow(pieces)), pieces)
    return whole.unionByName(done.select(*out))


def _streamed(schema: pa.Schema):
    """One row for each conversation of several pieces; its texts pass through the hash, only its audit is held."""
    totals = ["conv_id", "gaps", *COUNTS, "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                if b["piece"] == 0:
                    sha, audit, first = hashlib.sha256(), [], True
                audit.append(b["audit"])
                for t in b["repaired"]:
                    sha.update(("" if first else "\n").encode() + f"{t['role']}:{t['text']}".encode())
                    first = False
                if b["piece"] == b["pieces"] - 1:
                    row = {c: b[c] for c in totals} | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
                    yield pa.RecordBatch.from_pylist([row], schema)
    return run


def digests(pieces: DataFrame) -> DataFrame:
    """One row for each conversation: its totals, whole audit, and the hash of its repaired ``role:text`` lines."""
    joined = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    totals = ["conv_id", "gaps", *COUNTS, "illegal", "cost"]
    single = pieces.where("pieces = 1").select(*totals, "audit", F.sha2(joined, 256).alias("repaired_sha256"))
    kind = pieces.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {_TOTALS}, audit string, repaired_sha256 string"
    several = pieces.where("pieces > 1").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return single.unionByName(several.mapInArrow(_streamed(_arrow(schema)), schema))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops, 1 empties the text, 2 takes out ``.!?``, 3 repeats, 4 makes it user."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """The digests of the damaged conversations, with a row for every conversation that was there before."""
    there = conversations.select("conv_id").distinct()
    found = digests(repair(damaged(conversations))).withColumnRenamed("conv_id", "__conv")
    longs = ["gaps", *COUNTS, "illegal", "cost"]
    return there.join(found, there.conv_id.eqNullSafe(F.col("__conv")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in longs], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
