"""Frequent, fuzzy-frequent and periodic itemset mining on Spark DataFrames."""

from itemweave.operators.mining import (
    ENGINES,
    frequent_itemsets,
    fuzzy_frequent_itemsets,
    fuzzy_periodic_frequent_itemsets,
)
from itemweave.operators.results import Miner, MiningResult

__all__ = [
    "ENGINES",
    "Miner",
    "MiningResult",
    "frequent_itemsets",
    "fuzzy_frequent_itemsets",
    "fuzzy_periodic_frequent_itemsets",
]
