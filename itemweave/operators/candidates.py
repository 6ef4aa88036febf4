"""Candidate generation and support counting as stand-alone queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemweave.operators.dictionary import crisp_occurrences, fuzzy_occurrences, sum_type
from itemweave.plans.levels import broadcast_if, pack_units, rank_items, text_bytes
from itemweave.plans.numbering import number_rows
from itemweave.plans.settree import tree_support
from itemweave.plans.storage import Workspace

#: Sets sharing a prefix that one task pairs with a single partner range.
CLASS_PART = 1_000


def candidates(frequent: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Sets of size k+1 from the frequent sets of size k (``items`` sorted, all of one size).

    Two sets that agree in all but their last item give one candidate. With ``pairs`` (the frequent
    2-sets) a candidate also needs its last two items to be one of them. A prefix shared by very many
    sets is cut into ranges of partners, so no task pairs a whole class by itself.
    """
    sets = frequent.select(F.slice("items", F.lit(1), F.size("items") - 1).alias("prefix"),
                           F.element_at("items", -1).alias("last"))
    parts = sets.groupBy("prefix").agg(F.ceil(F.count(F.lit(1)) / F.lit(CLASS_PART)).cast("int").alias("parts"))
    sets = sets.join(parts, "prefix")
    left = sets.select("prefix", F.col("last").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = sets.select("prefix", F.col("last").alias("b"), F.pmod(F.xxhash64("last"), F.col("parts")).cast("int").alias("part"))
    grown = left.join(right, ["prefix", "part"]).where(F.col("a") < F.col("b"))
    if pairs is not None:
        known = pairs.select(F.get("items", F.lit(0)).alias("a"), F.get("items", F.lit(1)).alias("b"))
        grown = grown.join(known, ["a", "b"], "left_semi")
    return grown.select(F.concat("prefix", F.array("a", "b")).alias("items"))


def count_support(df: DataFrame, itemsets: DataFrame, fuzzy: bool = False) -> DataFrame:
    """Support and frequency of the given sets (``items``); a set that never occurs, or has no item, gets 0.

    The sets become a prefix tree that is walked along each packed transaction, so sets that begin alike are
    looked up once, and nothing but partial sums is shuffled after packing.
    """
    spark = df.sparkSession
    ws = Workspace(spark)
    sets = itemsets.select(F.array_sort(F.array_distinct("items")).alias("items")).distinct()
    wanted = sets.select(F.explode("items").alias("item")).distinct()
    occ = fuzzy_occurrences(df) if fuzzy else crisp_occurrences(df)
    occ = occ.join(wanted, "item", "left_semi").select(
        F.col("txn_id").alias("unit"), "item", F.col("prob").alias("m") if fuzzy else F.lit(1).alias("m")).persist()
    try:
        items = ws.write(occ.groupBy("item").agg(F.count(F.lit(1)).alias("freq")), "wanted-items")
        n_items, item_text = items.agg(F.count(F.lit(1)), text_bytes(F.col("item"))).first()
        ranked = rank_items(items, n_items, [F.col("freq"), F.col("item")], ws).select("item", "rank")
        ranked = broadcast_if(ranked, n_items, item_text)
        coded = (sets.select("items", F.explode("items").alias("item")).join(ranked, "item")
                 .groupBy("items").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
                 .where(F.size("ranks") == F.size("items")))
        # Rare items come first, so sets of one neighbourhood share the beginning of their paths.
        coded = ws.write(number_rows(coded, [F.col("ranks")], "sid", first=0, workspace=ws), "coded-sets")
        n_ranks = coded.agg(F.coalesce(F.sum(F.size("ranks")), F.lit(0))).first()[0]
        units = pack_units(occ.join(ranked, "item"), fuzzy, shortest=1)
        kind = sum_type(occ.schema["m"].dataType) if fuzzy else "bigint"
        totals = ws.write(tree_support(units, coded, n_ranks, fuzzy, kind), "supports")
    finally:
        occ.unpersist()
    totals = totals.join(coded.select("sid", "items"), "sid").drop("sid")
    zero = F.lit(0)
    return sets.join(totals, "items", "left").select(
        "items", F.size("items").alias("length"),
        F.coalesce("support", zero).alias("support"), F.coalesce("freq", zero).alias("freq"))
