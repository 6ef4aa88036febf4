"""The level-wise search, as one loop of narrow Spark plans.

A *unit* is what sets are counted over: one transaction, or (bitset counting) a word of 64
transactions. The state of level k has one row per unit and frequent (k-1)-set ``sid`` found in
it, with the sorted ranks ``r`` of every item that extends ``sid`` to a frequent k-set there, and
the matching values ``m``. Level 1 has ``sid = 0`` and all frequent items of the unit.

Counting level k+1 reads the state once: two positions i < j of ``r`` are one occurrence of the
candidate ``sid + r[i] + r[j]``, so the prefix join of the classic algorithm and the lookup of its
transactions are the same step, inside a row. Nothing moves except the per-task partial sums, at
most one row per candidate and task. The next state keeps, for each head ``r[i]``, only the later
items that turned out frequent, again inside the row. Units are shuffled once, when they are
packed; a long unit is cut into ranges of heads and spread before its pairs are formed.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from itemweave.plans.numbering import number_rows
from itemweave.plans.storage import Workspace

# A table of sets is broadcast up to this many rows and bytes of item text, both counted first; a
# larger one is left to Spark, which shuffles and splits skewed keys.
BROADCAST_SETS = 2_000_000
BROADCAST_TEXT = 256 * 2**20
# Heads per row before a long unit is cut and spread over tasks.
HEADS_PER_ROW = 2_048
# Longs in all extension bitmaps of a level together (32 MB) before lists are used instead.
BITMAP_LONGS = 4_000_000
# Distinct frequent items that a one-task ranking may hold.
RANK_IN_ONE_TASK = 200_000
# Levels between two states written to the shared folder to cut the lineage.
LEVELS_PER_CUT = 5


@dataclass(frozen=True)
class Counting:
    """How values combine along a set and what a candidate's rows add up to."""

    name: str
    has_values: bool
    combine: Callable[[Column, Column], Column]
    measures: Callable[[Column], list[Column]]
    alive: Callable[[Column], Column] | None = None


def _count() -> Column:
    return F.count(F.lit(1))


CRISP = Counting("crisp", False, lambda a, b: F.lit(1),
                 lambda m: [_count().alias("support"), _count().alias("freq")])
FUZZY = Counting("fuzzy", True, F.least,
                 lambda m: [F.sum(m).alias("support"), _count().alias("freq")])
BITSET = Counting("bitset", True, lambda a, b: a.bitwiseAND(b),
                  lambda m: [F.sum(F.bit_count(m)).cast("bigint").alias("support"),
                             F.sum(F.bit_count(m)).cast("bigint").alias("freq")],
                  lambda m: m != 0)


@dataclass
class LevelRun:
    """What the loop leaves behind: the frequent sets of each level and one statistics row each."""

    tables: list[DataFrame] = field(default_factory=list)
    stats: list[dict] = field(default_factory=list)
    local_states: list[DataFrame] = field(default_factory=list)
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        while self.held:
            self.held.pop().unpersist()


class Support:
    """Aggregates candidate occurrences and keeps the frequent candidates."""

    def __init__(self, counting: Counting, keep: Column):
        self.counting, self.keep = counting, keep

    #: columns a state must carry besides ``sid``, ``r`` and ``m``
    carried: tuple[str, ...] = ()

    def group(self, unit: Column) -> Column | None:
        """Units with the same value are packed into the same partition; None: any may be."""
        return None

    def totals(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(*self.counting.measures(F.col("m")))

    def columns(self) -> list[str]:
        return ["support", "freq"]


def _observed(totals: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Candidate statistics, gathered in the job that writes the survivors."""
    seen = Observation()
    return totals.observe(seen, *[c.alias(n) for n, c in metrics.items()]), seen


def _metrics(seen: Observation) -> dict:
    """Observed values; nothing if the plan turned out empty and was not run. They are reporting only:
    a task that ran twice may count twice, so the loop itself counts written tables."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def _stat(k: int, frequent: int, seen: dict, started: float, suffix: str = "") -> dict:
    return {"k": k, "candidates": max(int(seen.get(f"candidates{suffix}") or 0), frequent), "frequent": frequent,
            "occurrences": int(seen.get(f"occurrences{suffix}") or 0), "seconds": round(time.time() - started, 3)}


def rank_items(items: DataFrame, n_items: int, order: list[Column], ws: Workspace) -> DataFrame:
    """Dense ranks from 1. Few items are ranked in one task, many by a distributed sort."""
    if n_items <= RANK_IN_ONE_TASK:
        return items.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return number_rows(items, order, "rank", workspace=ws).withColumn("rank", F.col("rank").cast("int"))


def broadcast_if(df: DataFrame, rows: int, text: int = 0) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` and bytes of ``text`` are small enough."""
    return F.broadcast(df) if rows <= BROADCAST_SETS and text <= BROADCAST_TEXT else df


def text_bytes(col: Column) -> Column:
    """Bytes of item text, one item or a list per row."""
    return F.coalesce(F.sum(F.octet_length(col)), F.lit(0))


def pack_units(rows: DataFrame, has_values: bool, carried: tuple[str, ...] = (), shortest: int = 2,
               group: Column | None = None, placed: bool = False) -> DataFrame:
    """One row per unit from ``(unit, rank[, m])``. A unit holds each frequent item at most once,
    so a packed row is bounded by the size of the item dictionary. Rows that are ``placed`` by unit already stay where they are."""
    entry = F.struct("rank", "m") if has_values else F.col("rank")
    # A fixed number of partitions: pairing costs far more than the packed bytes suggest, so small
    # partitions must not be merged. The grouping reuses this shuffle.
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["unit"]
    if group is not None:
        rows, keys = rows if "grp" in rows.columns else rows.withColumn("grp", group), ["grp", "unit"]
    if not placed:
        rows = rows.repartition(n_parts, keys[0])
    # sort_array compares natively, array_sort through a lambda function.
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("t"))
    ranks = F.col("t.rank") if has_values else F.col("t")
    cols = [F.lit(0).cast("bigint").alias("sid"), ranks.alias("r")]
    if has_values:
        cols.append(F.col("t.m").alias("m"))
    cols += [F.col(c) for c in carried]
    return packed.where(F.size("t") >= shortest).select(*cols)


def _heads(state: DataFrame, widest: int) -> DataFrame:
    """One row per head position ``i`` (0-based) that has at least one later item."""
    last = F.size("r") - 2
    if widest <= HEADS_PER_ROW:
        return state.withColumn("i", F.explode(F.sequence(F.lit(0), last)))
    n_parts = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = state.where(F.size("r") <= HEADS_PER_ROW)
    spread = (state.where(F.size("r") > HEADS_PER_ROW)
              .withColumn("lo", F.explode(F.sequence(F.lit(0), last, F.lit(HEADS_PER_ROW))))
              .repartition(n_parts))
    return (short.withColumn("i", F.explode(F.sequence(F.lit(0), last)))
            .unionByName(spread.withColumn("i", F.explode(F.sequence(
                F.col("lo"), F.least(F.col("lo") + F.lit(HEADS_PER_ROW - 1), last)))).drop("lo")))


def candidate_rows(state: DataFrame, counting: Counting, carried: tuple[str, ...], widest: int,
                   pairs: DataFrame | None = None) -> DataFrame:
    """Every occurrence of every candidate: ``(sid, a, b, m)``. With ``pairs`` (rows of a pair table), only
    heads in it, and of their candidates those whose pair has its bit."""
    heads = _heads(state, widest).withColumn("a", F.get("r", F.col("i")))
    if pairs is not None:
        heads = heads.join(F.broadcast(pairs), "a")
    rows = heads.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.size("r") - 1))).withColumn("b", F.get("r", F.col("j")))
    if pairs is not None:
        word = F.get("bits", F.shiftright("b", 6).cast("int"))
        rows = rows.where(F.getbit(word, F.col("b").bitwiseAND(F.lit(63)).cast("int")) == 1)
    m = counting.combine(F.get("m", F.col("i")), F.get("m", F.col("j"))) if counting.has_values else F.lit(1)
    rows = rows.select("sid", "a", "b", *carried, m.alias("m"))
    return rows.where(counting.alive(F.col("m"))) if counting.alive else rows


def pair_table(level: DataFrame, n_items: int, ws: Workspace) -> list[DataFrame]:
    """The frequent pairs as a triangular table of bits, ``(a, bits)`` by rank, in ranges of heads.

    A head's words are put together with ``bit_or``, so a range has at most ``BITMAP_LONGS`` words however many pairs there are,
    and each may be broadcast. More items only mean more ranges.
    """
    width = (n_items >> 6) + 1
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b").bitwiseAND(F.lit(63)))
    words = (level.groupBy("a", F.shiftright("b", 6).alias("w")).agg(F.bit_or(bit).alias("word"))
             .groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("w", "word"))).alias("ws")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda w: F.coalesce(F.try_element_at("ws", w), F.lit(0).cast("bigint")))
    table = ws.write(words.select("a", dense.alias("bits")), "pairs")
    heads = max(BITMAP_LONGS // width, 1)
    return [table.where((F.col("a") >= lo) & (F.col("a") < lo + heads)) for lo in range(1, n_items + 1, heads)]


def extension_classes(level: DataFrame) -> DataFrame:
    """Prefixes of a level with at least two frequent extensions: only these can grow."""
    return (level.groupBy("sid", "a", "pid").agg(F.sort_array(F.collect_list("b")).alias("ext"),
                                                 F.sum("freq").alias("weight"))
            .where(F.size("ext") > 1))


def _as_bitmap(classes: DataFrame, n_items: int) -> DataFrame:
    """Replace the extension list by 64-bit words, indexed by rank / 64."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b").bitwiseAND(F.lit(63)))
    words = (classes.select("sid", "a", "pid", F.explode("ext").alias("b"))
             .groupBy("sid", "a", "pid", F.shiftright("b", 6).alias("w")).agg(F.bit_or(bit).alias("bits"))
             .groupBy("sid", "a", "pid").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("ws")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(n_items >> 6)),
                        lambda w: F.coalesce(F.try_element_at("ws", w), F.lit(0).cast("bigint")))
    return words.select("sid", "a", "pid", dense.alias("ext"))


def next_state(state: DataFrame, classes: DataFrame, counting: Counting, carried: tuple[str, ...],
               widest: int, n_items: int, bitmap: bool, n_sets: int) -> DataFrame:
    """State of the next level: for each head, the later items that are frequent with it."""
    if bitmap:
        classes = _as_bitmap(classes, n_items)

        def allowed(rank: Column) -> Column:
            word = F.get("ext", F.shiftright(rank, 6).cast("int"))
            return F.getbit(word, rank.bitwiseAND(F.lit(63)).cast("int")) == 1
    else:
        def allowed(rank: Column) -> Column:
            return F.array_contains("ext", rank)

    heads = _heads(state, widest).withColumn("a", F.get("r", F.col("i")))
    if n_sets > BROADCAST_SETS:  # heads travel: each with what comes after it only
        rest = {c: F.slice(c, F.col("i") + 1, F.size(c) - F.col("i")) for c in (("r", "m") if counting.has_values else ("r",))}
        heads = heads.withColumns(rest).withColumn("i", F.lit(0))
    heads = heads.join(broadcast_if(classes.select("sid", "a", "pid", "ext"), n_sets), ["sid", "a"])
    later = F.sequence(F.col("i") + 1, F.size("r") - 1)

    def keep(j: Column) -> Column:
        ok = allowed(F.get("r", j))
        if counting.alive:
            ok = ok & counting.alive(counting.combine(F.get("m", F.col("i")), F.get("m", j)))
        return ok

    heads = heads.withColumn("js", F.filter(later, keep)).where(F.size("js") > 1)
    cols = [F.col("pid").alias("sid"), F.transform("js", lambda j: F.get("r", j)).alias("r")]
    if counting.has_values:
        cols.append(F.transform(
            "js", lambda j: counting.combine(F.get("m", F.col("i")), F.get("m", j))).alias("m"))
    return heads.select(*cols, *carried)


def dense_state(state: DataFrame, classes: DataFrame, counting: Counting, carried: tuple[str, ...], widest: int, n_sets: int) -> DataFrame:
    """The same where nearly all pairs are frequent: for each head, all later items. What this leaves in is counted and found infrequent, as
    before any set that holds a pair below the threshold; testing each item costs more than that."""
    heads = _heads(state, widest).where(F.size("r") - F.col("i") > 2).withColumn("a", F.get("r", F.col("i")))
    later = {c: F.slice(c, F.col("i") + 2, F.size(c)) for c in (("r", "m") if counting.has_values else ("r",))}
    head = [F.get("m", F.col("i")).alias("head")] if counting.has_values else []
    heads = heads.select("sid", "a", *carried, *head, *[e.alias(c) for c, e in later.items()])
    heads = heads.join(broadcast_if(classes.select("sid", "a", "pid"), n_sets), ["sid", "a"])
    cols = [F.col("pid").alias("sid"), F.col("r")]
    if counting.has_values:
        cols.append(F.transform("m", lambda m: counting.combine(F.col("head"), m)).alias("m"))
    return heads.select(*cols, *carried)


def _longest(state: DataFrame) -> int:
    """The longest row; computes the state as well."""
    return state.agg(F.max(F.size("r"))).first()[0] or 0


class Steps:
    """The three steps of the level loop on packed rows: pack, count a level, and build the next state."""

    def __init__(self, support: Support, ws: Workspace, placed: bool = False):
        self.support, self.counting, self.carried, self.ws, self.placed = support, support.counting, support.carried, ws, placed
        self.pairs: list[DataFrame | None] = [None]
        self.widest = 0
        # Whether rows as packed here may keep items that are not frequent with their head; empty words must go.
        self.keeps_all = type(self) is Steps and self.counting.alive is None

    def pack(self, rows: DataFrame) -> DataFrame:
        return pack_units(rows, self.counting.has_values, self.carried, group=self.support.group(F.col("unit")),
                          placed=self.placed)

    def totals(self, state: DataFrame, widest: int) -> DataFrame:
        self.widest = widest
        rows = None
        for pairs in self.pairs:
            part = candidate_rows(state, self.counting, self.carried, widest, pairs)
            rows = part if rows is None else rows.unionByName(part)
        return self.support.totals(rows, ["sid", "a", "b"])

    def extend(self, state: DataFrame, classes: DataFrame, n_sets: int, n_items: int, bitmap: bool) -> DataFrame:
        return next_state(state, classes, self.counting, self.carried, self.widest, n_items, bitmap, n_sets)

    def advance(self, state: DataFrame, level: DataFrame, n_sets: int, n_items: int, k: int,
                classes: DataFrame | None = None) -> DataFrame:
        bitmap = n_items > 128 and n_sets // 2 * ((n_items >> 6) + 1) <= BITMAP_LONGS
        classes = extension_classes(level) if classes is None else classes
        # With nearly all pairs frequent there is nothing to prune.
        if k == 2 and n_sets < 0.4 * n_items * (n_items - 1):
            self.pairs = pair_table(level, n_items, self.ws)
        elif k == 2 and self.keeps_all:
            return dense_state(state, classes, self.counting, self.carried, self.widest, n_sets)
        return self.extend(state, classes, n_sets, n_items, bitmap)


def grow(units: DataFrame, first: DataFrame, n_items: int, item_text: int, support: Support, ws: Workspace,
         run: LevelRun, max_len: int | None, split_local: Callable | None = None, steps: Steps | None = None) -> LevelRun:
    """Levels 2 and up. ``first`` is the ranked dictionary ``(rank, item, ...)``; ``units`` the packed
    level-1 state; ``item_text`` the bytes of all items. ``split_local(classes)`` may take
    over prefix classes small enough to finish in one task each; it returns the classes that stay
    in the loop and those it takes."""
    steps = steps or Steps(support, ws)
    names = broadcast_if(first.select(F.col("rank").alias("b"), F.col("item").alias("name")), n_items, item_text)
    parents = first.select(F.lit(0).cast("bigint").alias("sid"), F.col("rank").alias("a"),
                           F.col("rank").cast("bigint").alias("pid"), F.array("item").alias("prefix"),
                           F.col("freq").alias("pfreq"))
    parents = broadcast_if(parents, n_items, item_text)
    # Rows are no longer than the dictionary and get shorter by an item a level; they are measured where that says too little.
    n_parents, state, k, widest = n_items, units, 1, n_items
    run.held.append(state)
    # A (k+1)-set needs k+1 frequent subsets of size k; two of them are of one class, where others may have been taken over.
    while n_parents > (1 if split_local else k) and (max_len is None or k < max_len):
        started = time.time()
        if widest > HEADS_PER_ROW:
            widest = _longest(state)
        totals = steps.totals(state, widest)
        widest -= 1
        k += 1
        totals, seen = _observed(totals, candidates=_count(), occurrences=F.sum("freq"))
        level = (totals.where(support.keep).join(parents, ["sid", "a"]).join(names, "b")
                 .select(F.monotonically_increasing_id().alias("id"), "pid", "sid", "a", "b", "pfreq",
                         F.array_append("prefix", F.col("name")).alias("items"), *support.columns()))
        level = ws.write(level, f"level-{k}")
        n_sets, text = level.agg(_count(), text_bytes(F.array_join("items", ","))).first()
        run.stats.append(_stat(k, n_sets, _metrics(seen), started))
        if n_sets:
            run.tables.append(level)
        if n_sets <= (1 if split_local else k) or (max_len is not None and k >= max_len):
            break
        if split_local is None:
            state = steps.advance(state, level, n_sets, n_items, k)
        else:
            classes, taken = split_local(extension_classes(level))
            run.local_states.append(steps.extend(state, taken, n_sets, n_items, False))
            state = steps.advance(state, level, n_sets, n_items, k, classes)
        if k % LEVELS_PER_CUT == 0:
            state = ws.write(state, f"state-{k}")
        else:
            state = state.persist()
            run.held.append(state)
        parents = level.select(F.col("pid").alias("sid"), F.col("b").alias("a"), F.col("id").alias("pid"),
                               F.col("items").alias("prefix"), F.col("freq").alias("pfreq"))
        parents = broadcast_if(parents, n_sets, text)
        # Only the newest two states are needed: the one read and the one built from it.
        while len(run.held) > 2 and not run.local_states:
            run.held.pop(0).unpersist()
        n_parents = n_sets
    return run
