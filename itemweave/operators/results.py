"""What a miner returns, and a base class for user-written miners."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemweave.sources import writers


class MiningResult:
    """Frequent sets ``(items, length, support, freq)`` with per-level statistics.

    The table holds each set once, its items in ascending order.
    """

    def __init__(self, itemsets: DataFrame, stats: list[dict], seconds: float, workspace=None):
        self.itemsets, self.stats, self.seconds, self.workspace = itemsets, stats, seconds, workspace

    def close(self) -> None:
        """Delete the tables behind the sets; neither they nor frames made from them can be read afterwards."""
        if self.workspace is not None:
            self.workspace.drop()

    def rescaled(self, scaling_factor: int) -> MiningResult:
        """Supports divided by the fixed-point scale."""
        if scaling_factor == 1:
            return self
        scaled = self.itemsets.withColumn("support", F.col("support") / F.lit(scaling_factor))
        return MiningResult(scaled, self.stats, self.seconds, self.workspace)

    @property
    def levels(self) -> DataFrame:
        """One row per level: candidates seen, frequent ones, their occurrences, seconds."""
        return self.itemsets.sparkSession.createDataFrame(
            [(s["k"], s["candidates"], s["frequent"], s["occurrences"], float(s["seconds"])) for s in self.stats],
            "k int, candidates bigint, frequent bigint, occurrences bigint, seconds double")

    def count(self) -> int:
        """Known from the level loop; other engines count their table."""
        return sum(s["frequent"] for s in self.stats) if self.stats else self.itemsets.count()

    def to_frame(self, sep: str = "\t") -> DataFrame:
        """``Patterns`` as text and ``Support``."""
        return self.itemsets.select(F.array_join("items", sep).alias("Patterns"), F.col("support").alias("Support"))

    def to_dict(self) -> dict[tuple[str, ...], float]:
        """All sets on the driver, for results known to be small."""
        return {tuple(r["items"]): r["support"] for r in self.itemsets.select("items", "support").toLocalIterator()}

    def save(self, path: str, style: str = "comma") -> None:
        writers.write_itemsets(self.itemsets, path, style)

    def summary(self, name: str = "Miner") -> str:
        head = f"--- {name} Results ---"
        return "\n".join([head, f"Execution Time: {self.seconds:.4f} seconds",
                          f"Patterns Found: {self.count()}", "-" * len(head)])


class Miner(ABC):
    """Base class for a new algorithm: implement ``_mine``; ``mine`` runs and times it."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.result: MiningResult | None = None

    @abstractmethod
    def _mine(self) -> DataFrame:
        """Return ``(items, length, support, freq)``."""

    def mine(self) -> MiningResult:
        started = time.time()
        found = self._mine()
        self.result = MiningResult(found, [], time.time() - started)
        return self.result

    def _done(self) -> MiningResult:
        if self.result is None:
            raise RuntimeError("call mine() first")
        return self.result

    def get_execution_time(self) -> float:
        return self._done().seconds

    def get_pattern_count(self) -> int:
        return self._done().count()

    def get_patterns(self) -> DataFrame:
        return self._done().itemsets

    def save(self, path: str) -> None:
        self._done().save(path)

    def print_results(self) -> None:
        print(self._done().summary(type(self).__name__))
