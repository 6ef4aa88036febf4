"""Column helpers shared by the readers, the miners and the layout operators."""

from itemweave.functions.columns import (
    aligned_pairs,
    human_bytes,
    itemset_text,
    megabytes_per_second,
    split_items,
    split_literal,
    trim_trailing,
    trimmed_mean,
)

__all__ = [
    "aligned_pairs",
    "human_bytes",
    "itemset_text",
    "megabytes_per_second",
    "split_items",
    "split_literal",
    "trim_trailing",
    "trimmed_mean",
]
