"""Tables about mining runs: logs, comparisons, timings and threshold sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemweave.functions.columns import trimmed_mean
from itemweave.operators.results import MiningResult

# What a run prints before and behind each number.
LOG_LABELS = {
    "exec_time": (("Execution Time:",), "seconds"),
    "cpu_mem_mb": (("Peak CPU Memory Usage:", "CPU Memory Usage:", "Peak CPU Memory:", "CPU Memory:"), "MB"),
    "gpu_mem_mb": (("Peak GPU (driver) Used:",), "MB"),
    "patterns_found": (("Total Patterns Found:", "Patterns Found:"), ""),
}


def _number_after(text: str, labels: tuple[str, ...], unit: str) -> Column:
    """The number between a label at the start of a line and a unit at its end, in any case; NULL without such a line."""
    lines = F.transform(F.split(F.lower(text), "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))

    def after(label: str) -> Column:
        fits = F.filter(lines, lambda x: F.startswith(x, F.lit(label)) & F.endswith(x, F.lit(unit.lower())))
        between = F.transform(fits, lambda x: F.substring(x, F.lit(len(label) + 1), F.length(x) - len(label) - len(unit)))
        return F.btrim(F.get(between, 0), F.lit(" \t"))

    return F.coalesce(*[after(label.lower()).try_cast("double") for label in labels])


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per log file: ``(path, text)``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def extract_metrics(logs: DataFrame, text: str = "text") -> DataFrame:
    """The log columns without the text, plus one DOUBLE per metric; NULL if the log has no such line."""
    keep = [c for c in logs.columns if c != text]
    return logs.select(*keep, *[_number_after(text, *label).alias(name) for name, label in LOG_LABELS.items()])


def comparison_table(metrics: DataFrame, algorithms: list[str], support: str = "support_quant_int") -> DataFrame:
    """Per support: time and pattern count of each algorithm, largest support first.

    Columns are ``time_<algorithm>`` and ``patterns_<algorithm>``.
    """
    rows = metrics.where(F.col("algorithm").isin(*algorithms))
    wide = rows.groupBy(support).pivot("algorithm", algorithms).agg(
        F.first("exec_time").alias("time"), F.first("patterns_found").alias("patterns"))
    columns = [F.col(f"`{a}_{kind}`").alias(f"{kind}_{a}") for kind in ("time", "patterns") for a in algorithms]
    return wide.select(support, *columns).orderBy(F.col(support).desc())


def timing_summary(runs: DataFrame, keys: list[str], seconds: str = "seconds") -> DataFrame:
    """Runs and trimmed mean time per key."""
    return runs.groupBy(*keys).agg(F.count(seconds).alias("runs"), trimmed_mean(F.col(seconds)).alias("mean_seconds"))


def threshold_sweep(result: MiningResult, thresholds: list, by_length: bool = False) -> DataFrame:
    """How many sets reach each threshold, from one run at the lowest of them.

    The sets at a higher threshold are exactly those of the run whose support reaches it.
    """
    def reached(t) -> Column:
        return F.col("support") >= F.lit(t)

    passed = F.array(*[F.when(reached(t), F.lit(t)) for t in sorted(set(thresholds))])
    keys = ["min_support", "length"] if by_length else ["min_support"]
    rows = result.itemsets.select(F.explode(passed).alias("min_support"), "length", "support")
    counted = rows.where(F.col("min_support").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("patterns"), F.max("length").alias("longest"), F.sum("support").alias("total_support"))
    if by_length:
        counted = counted.drop("longest")
    return counted


def largest(values: list, k: int = 1) -> list:
    """The ``k`` largest thresholds of a run plan."""
    return sorted(values, reverse=True)[:k]


def largest_rows(df: DataFrame, by: str, k: int = 1) -> DataFrame:
    """The rows with the ``k`` largest values of a column, ties included; each task sends its ``k`` largest."""
    top = df.select(by).where(F.col(by).isNotNull()).distinct().orderBy(F.desc(by)).limit(k)
    return df.join(F.broadcast(top), by, "left_semi")


def metrics_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Run metrics in the shape the tables above read."""
    return spark.createDataFrame(
        rows, "dataset string, sf int, algorithm string, support_quant_int bigint, quant_mult bigint, "
              "exec_time double, cpu_mem_mb double, gpu_mem_mb double, patterns_found bigint")


def result_metrics(result: MiningResult, dataset: str, algorithm: str, min_support: int, sf: int = 1, multiplier: int = 1) -> DataFrame:
    """The metrics row of one run: its time and the number of its sets; memory is not measured."""
    spark = result.itemsets.sparkSession
    return metrics_frame(spark, [(dataset, sf, algorithm, min_support, multiplier, float(result.seconds), None, None, result.count())])


def union_metrics(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
