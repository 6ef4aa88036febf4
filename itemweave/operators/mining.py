"""The miners: crisp, fuzzy, fuzzy with a frequency threshold, and fuzzy periodic itemsets."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemweave.operators.dictionary import (
    crisp_occurrences,
    fuzzy_occurrences,
    parse_threshold,
    require_columns,
    resolve_threshold,
    share_of,
    sum_type,
    transaction_count,
)
from itemweave.operators.results import MiningResult
from itemweave.plans.levels import (
    BITSET,
    BROADCAST_SETS,
    BROADCAST_TEXT,
    CRISP,
    FUZZY,
    Counting,
    LevelRun,
    Steps,
    Support,
    _metrics,
    _observed,
    _stat,
    broadcast_if,
    grow,
    rank_items,
    text_bytes,
)
from itemweave.plans.periodic import PeriodicSupport
from itemweave.plans.storage import Workspace


def _keep(min_support, min_frequency: int | None = None, min_periodic: int | None = None) -> Column:
    keep = F.col("support") >= F.lit(min_support)
    if min_frequency is not None:
        keep = keep & (F.col("freq") >= F.lit(min_frequency))
    if min_periodic is not None:
        keep = keep & (F.col("periodic_freq") >= F.lit(min_periodic))
    return keep


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _integral(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _transactions(occ: DataFrame, counting: Counting) -> int:
    """Transactions behind the cached occurrences; bitset words hold up to 64 of them."""
    if counting is not BITSET:
        return occ.agg(F.count_distinct("unit")).first()[0]
    words = occ.groupBy("unit").agg(F.bit_or("m").alias("any"))
    return words.agg(F.coalesce(F.sum(F.bit_count("any")), F.lit(0))).first()[0]


def _search(occ: DataFrame, unit: Column, value: Column, min_support, support_for: Callable[..., Support],
            max_len: int | None, started: float, n_transactions: int | None = None,
            split_local: Callable | None = None, finish_local: Callable | None = None, steps: Steps | None = None,
            placed: bool = False, stored: bool = False) -> MiningResult:
    """Dictionary, one packing shuffle, then the level loop. ``occ`` holds one row per item and unit;
    ``support_for`` takes the threshold as a count. Rows are ``placed`` if all of a unit (or of its ``grp``) are in one partition,
    ``stored`` if they were so in the input."""
    spark = occ.sparkSession
    if max_len is not None and max_len < 1:
        raise ValueError("max_len must be at least 1")
    ws, run = Workspace(spark), LevelRun()
    threshold, proportion = parse_threshold(min_support)
    # The transaction count, the dictionary and the packing all read the deduplicated rows.
    grp = [c for c in occ.columns if c == "grp"]
    cached = occ.select(*grp, unit.alias("unit"), "item", value.alias("m")).persist()
    try:
        if proportion:
            counting = support_for(0).counting
            threshold = share_of(threshold, n_transactions if n_transactions is not None else _transactions(cached, counting))
        support = support_for(threshold)
        occ = cached.where(F.col("m") > 0) if support.counting is FUZZY else cached
        t0 = time.time()
        totals, seen = _observed(support.totals(occ, ["item"]), candidates=F.count(F.lit(1)), occurrences=F.sum("freq"))
        items = ws.write(totals.where(support.keep).select("item", *support.columns()), "items")
        n_items, item_text = items.agg(F.count(F.lit(1)), text_bytes(F.col("item"))).first()
        run.stats.append(_stat(1, n_items, _metrics(seen), t0))
        if n_items:
            run.tables.append(items.select(F.array("item").alias("items"), *support.columns()))
        if n_items > 1 and max_len != 1:
            # Rare items first keeps the later parts of a unit, and so the next states, small.
            first = rank_items(items, n_items, [F.col("freq"), F.col("item")], ws)
            names = first.select("item", "rank")
            rows = occ.join(broadcast_if(names, n_items, item_text), "item").select(*grp, "unit", "rank", "m")
            # A join that shuffles by item leaves nothing where it was placed.
            steps = steps or Steps(support, ws, placed and (stored or n_items <= BROADCAST_SETS and item_text <= BROADCAST_TEXT))
            units = steps.pack(rows).persist()
            grow(units, first, n_items, item_text, support, ws, run, max_len, split_local, steps)
            if run.local_states:
                run.tables.extend(finish_local(run, first, ws))
    finally:
        run.release()
        cached.unpersist()
    columns = ["items", *support.columns()]
    value_type = sum_type(occ.schema["m"].dataType) if support.counting is FUZZY else "bigint"
    found = None
    for table in run.tables:
        part = table.select(*columns)
        found = part if found is None else found.unionByName(part)
    if found is None:
        schema = "items array<string>, " + ", ".join(f"{c} bigint" for c in columns[1:])
        found = spark.createDataFrame([], schema)
    itemsets = found.select(
        F.array_sort("items").alias("items"), F.size("items").alias("length"),
        F.col("support").cast(value_type).alias("support"),
        *[F.col(c).cast("bigint").alias(c) for c in columns[2:]])
    # The sets of each level are the result; what only led to them goes.
    ws.drop("pairs", "ordered-rank", "offsets-rank", *[f"state-{s['k']}" for s in run.stats])
    return MiningResult(itemsets, run.stats, time.time() - started, ws)


# --- crisp -------------------------------------------------------------------------------------

@contextmanager
def _without_rare(df: DataFrame, min_support, n_transactions: int | None) -> Iterator[tuple[DataFrame, int | None]]:
    """The rows whose items may be frequent, and the number of transactions.

    An item with fewer occurrences than the threshold, repeats included, is in fewer transactions too. Counting occurrences moves a row for each item
    and task only, so where such items hold half of the occurrences or more they go before anything is shuffled by
    transaction, at the price of reading the input again. Otherwise all rows are left as they are.
    """
    threshold, proportion = parse_threshold(min_support)
    if proportion:
        n_transactions = transaction_count(df) if n_transactions is None else n_transactions
        threshold = share_of(threshold, n_transactions)
    if threshold <= 1:
        yield df, n_transactions
        return
    ws = Workspace(df.sparkSession)
    known = df.where(F.col("item").isNotNull() & F.col("txn_id").isNotNull())
    counts, seen = _observed(known.groupBy("item").agg(F.count(F.lit(1)).alias("n")), total=F.sum("n"))
    try:
        likely = ws.write(counts.where(F.col("n") >= F.lit(threshold)), "likely")
        n_items, text, left = likely.agg(F.count(F.lit(1)), text_bytes(F.col("item")), F.coalesce(F.sum("n"), F.lit(0))).first()
        if 2 * left <= (_metrics(seen).get("total") or 0):
            df = known.join(broadcast_if(likely.select("item"), n_items, text), "item", "left_semi")
        yield df, n_transactions
    finally:
        ws.drop()


def _crisp_join(df: DataFrame, min_support, max_len: int | None, started: float,
                n_transactions: int | None, placed: bool = False) -> MiningResult:
    return _search(crisp_occurrences(df), F.col("txn_id"), F.lit(1), min_support,
                   lambda t: Support(CRISP, _keep(t)), max_len, started, n_transactions, placed=placed, stored=placed)


def _crisp_stored(*args) -> MiningResult:
    """The same for a table stored by transaction (``writers.write_stored``): its occurrences are packed where they lie. For any
    other table Spark shuffles as it needs to."""
    return _crisp_join(*args, placed=True)


def _crisp_bitset(df: DataFrame, min_support, max_len: int | None, started: float,
                  n_transactions: int | None) -> MiningResult:
    """Words of 64 transactions by position. Ids must be whole numbers; ids without large holes fill
    the words best. Building the words also removes repeated items."""
    require_columns(df, "txn_id", "item")
    if not _integral(df, "txn_id"):
        raise ValueError("engine='bitset' needs whole-number txn_id; number the transactions first")
    txn = F.col("txn_id").cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), txn.bitwiseAND(F.lit(63)).cast("int"))
    words = (df.where(F.col("item").isNotNull() & F.col("txn_id").isNotNull())
             .groupBy(F.shiftright(txn, 6).alias("word"), F.col("item")).agg(F.bit_or(bit).alias("bits")))
    return _search(words, F.col("word"), F.col("bits"), min_support, lambda t: Support(BITSET, _keep(t)),
                   max_len, started, n_transactions)


def _crisp_bitmap(df: DataFrame, min_support, max_len: int | None, started: float,
                  n_transactions: int | None) -> MiningResult:
    """Compressed bitmaps over runs of transactions; ids may be anything that sorts, with any holes."""
    from itemweave.plans.bitmaps import BitmapSteps

    return _search(crisp_occurrences(df), F.col("txn_id"), F.lit(1), min_support, lambda t: Support(CRISP, _keep(t)),
                   max_len, started, n_transactions, steps=BitmapSteps())


def _crisp_fpgrowth(df: DataFrame, min_support, max_len: int | None, started: float,
                    n_transactions: int | None) -> MiningResult:
    """Prefix trees of conditional transactions, by groups of items; see :mod:`itemweave.plans.fptrees`."""
    from itemweave.plans.fptrees import mine_trees

    if max_len is not None and max_len < 1:
        raise ValueError("max_len must be at least 1")
    occ = crisp_occurrences(df)
    tables, stats, ws = mine_trees(occ, max(1, math.ceil(resolve_threshold(min_support, occ, n_transactions))), max_len)
    found = df.sparkSession.createDataFrame([], "items array<string>, freq bigint")
    for sets in tables:
        found = found.unionByName(sets)
    found = ws.write(found.select(F.array_sort("items").alias("items"), F.size("items").alias("length"),
                                  F.col("freq").alias("support"), "freq"), "found")
    return MiningResult(found, stats, time.time() - started, ws)


def _crisp_grouped(df: DataFrame, min_support, max_len: int | None, started: float,
                   n_transactions: int | None) -> MiningResult:
    from itemweave.operators.grouped import mine_grouped

    occ = crisp_occurrences(df).withColumn("prob", F.lit(1).cast("bigint"))
    threshold = resolve_threshold(min_support, occ, n_transactions)
    return mine_grouped(_search, occ, threshold, lambda t: Support(FUZZY, _keep(t)), None, max_len, started)


# Register another engine by adding a function
# (df, min_support, max_len, started, n_transactions) -> MiningResult.
ENGINES: dict[str, Callable[..., MiningResult]] = {
    "join": _crisp_join,
    "stored": _crisp_stored,
    "bitset": _crisp_bitset,
    "bitmap": _crisp_bitmap,
    "fpgrowth": _crisp_fpgrowth,
    "grouped": _crisp_grouped,
}


def frequent_itemsets(df: DataFrame, min_support, max_len: int | None = None, engine: str = "join",
                      n_transactions: int | None = None) -> MiningResult:
    """Every set of items that at least ``min_support`` transactions hold together.

    ``df`` has ``txn_id`` and ``item``. An int threshold is a count, a float a proportion.
    """
    started = time.time()
    if engine not in ENGINES:
        raise ValueError(f"unknown engine {engine!r}; known: {sorted(ENGINES)}")
    require_columns(df, "txn_id", "item")
    if engine == "stored":  # nothing is shuffled by transaction
        return ENGINES[engine](df, min_support, max_len, started, n_transactions)
    with _without_rare(df, min_support, n_transactions) as (rows, n_transactions):
        return ENGINES[engine](rows, min_support, max_len, started, n_transactions)


# --- fuzzy -------------------------------------------------------------------------------------

def _fuzzy_join(df: DataFrame, min_support, min_frequency: int | None, max_len: int | None, on_duplicate: str,
                started: float, n_transactions: int | None, stored: bool = False) -> MiningResult:
    # A proportion needs the transactions whose items are all absent as well.
    count_all = parse_threshold(min_support)[1] and n_transactions is None
    parts = None if stored else _parts(df)
    return _search(fuzzy_occurrences(df, on_duplicate, keep_absent=count_all, parts=parts), F.col("txn_id"), F.col("prob"),
                   min_support, lambda t: Support(FUZZY, _keep(t, min_frequency)), max_len, started, n_transactions, placed=True, stored=stored)


def _fuzzy_stored(*args) -> MiningResult:
    """The same for a table stored by transaction."""
    return _fuzzy_join(*args, stored=True)


def _fuzzy_grouped(df: DataFrame, min_support, min_frequency: int | None, max_len: int | None, on_duplicate: str,
                   started: float, n_transactions: int | None) -> MiningResult:
    from itemweave.operators.grouped import mine_grouped

    threshold = resolve_threshold(min_support, df, n_transactions)
    return mine_grouped(_search, fuzzy_occurrences(df, on_duplicate), threshold,
                        lambda t: Support(FUZZY, _keep(t, min_frequency)), min_frequency, max_len, started)


# Register another engine by adding a function
# (df, min_support, min_frequency, max_len, on_duplicate, started, n_transactions) -> MiningResult.
FUZZY_ENGINES: dict[str, Callable[..., MiningResult]] = {"join": _fuzzy_join, "stored": _fuzzy_stored, "grouped": _fuzzy_grouped}


def fuzzy_frequent_itemsets(df: DataFrame, min_support, min_frequency: int | None = None,
                            scaling_factor: int = 1, max_len: int | None = None, engine: str = "join",
                            on_duplicate: str = "max", n_transactions: int | None = None) -> MiningResult:
    """Every set whose sum, over transactions, of the smallest membership reaches ``min_support``
    and (if given) that at least ``min_frequency`` transactions hold.

    ``prob`` may be whole numbers (fixed point, exact) or doubles. The threshold is in the units of
    ``prob``; supports are divided by ``scaling_factor`` in the result.
    """
    started = time.time()
    if engine not in FUZZY_ENGINES:
        raise ValueError(f"unknown engine {engine!r}; known: {sorted(FUZZY_ENGINES)}")
    result = FUZZY_ENGINES[engine](df, min_support, min_frequency, max_len, on_duplicate, started, n_transactions)
    return result.rescaled(scaling_factor)


def _periodic_join(df: DataFrame, min_support, min_periodic_frequency: int, max_gap: int, max_len: int | None,
                   on_duplicate: str, started: float) -> MiningResult:
    threshold = resolve_threshold(min_support, df)
    low, high = df.agg(F.min("txn_id"), F.max("txn_id")).first()
    if low is None:
        low = high = 0
    # Ids count from the smallest one, so that words and groups of words start at 0.
    unit, parts = F.col("txn_id").cast("bigint") - F.lit(low), _parts(df)
    support = PeriodicSupport(FUZZY, _keep(threshold, None, min_periodic_frequency), max_gap, high - low, parts)
    return _search(fuzzy_occurrences(df, on_duplicate, parts=parts, group=support.group(unit)), unit, F.col("prob"), 0,
                   lambda _: support, max_len, started, placed=True)


# Register another engine by adding a function
# (df, min_support, min_periodic_frequency, max_gap, max_len, on_duplicate, started) -> MiningResult.
PERIODIC_ENGINES: dict[str, Callable[..., MiningResult]] = {"join": _periodic_join}


def fuzzy_periodic_frequent_itemsets(df: DataFrame, min_support, min_periodic_frequency: int, max_gap: int,
                                     scaling_factor: int = 1, max_len: int | None = None,
                                     on_duplicate: str = "max", engine: str = "join") -> MiningResult:
    """Fuzzy frequent sets that also come back regularly.

    The periodic frequency of a set is the number of consecutive occurrences whose ``txn_id`` values
    are at most ``max_gap`` apart. Adding an item can only lose occurrences and widen gaps, so the
    threshold prunes exactly. Without a ``prob`` column every membership is 1.
    """
    started = time.time()
    if engine not in PERIODIC_ENGINES:
        raise ValueError(f"unknown engine {engine!r}; known: {sorted(PERIODIC_ENGINES)}")
    require_columns(df, "txn_id", "item")
    if not _integral(df, "txn_id"):
        raise ValueError("periodic mining needs whole-number txn_id")
    if "prob" not in df.columns:
        df = df.withColumn("prob", F.lit(1).cast("bigint"))
    result = PERIODIC_ENGINES[engine](df, min_support, min_periodic_frequency, max_gap, max_len, on_duplicate, started)
    return result.rescaled(scaling_factor)
