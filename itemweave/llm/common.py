"""Scratch tables, words, size-checked joins and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: \x20 and \x09 to \x0D. bytes.split() splits at the same bytes.
SPACE = " \t\n\x0b\x0c\r"
#: A join side of at most so many rows (of a long or two) may be broadcast; it is counted first.
BROADCAST_ROWS = 400_000


class Scratch:
    """Tables written to the folder that the cluster shares, so that a lost executor costs no more than its tasks.

    The folder is ``spark.checkpoint.dir``. Where that is unset, as in tests on a local master, it is a temporary
    folder; on a cluster without the setting it is an error.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="llm-")
        self.root = f"{root.rstrip('/')}/llm-{uuid.uuid4().hex[:12]}"
        # Workers on the driver's machine find this package where the driver did; others get it by --py-files.
        env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
        if here not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), here]))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, batch: int = 1000) -> DataFrame:
        """Write a table and read it back; Python stages inside get ``batch`` rows at a time.

        The job's shuffle files go as soon as the table is written, or the disk would hold those of all jobs until the
        driver happens to collect its garbage. Both settings hold for this one write.
        """
        own = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch),
               "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
        before = {k: self.spark.conf.get(k) for k in own}
        try:
            for k, v in own.items():
                self.spark.conf.set(k, v)
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later read needs; a failure to delete is harmless."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+``; NULL and blank texts have none."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed != "", F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on costly computed columns as they stand.

    A plain filter is pushed below the projections by copying their expressions into it, also into the bodies of array
    functions, where they run once an element. A column that Spark takes for non-deterministic stops that.
    """
    return (df.withColumn("__fence", F.monotonically_increasing_id())
            .where(condition & (F.col("__fence") >= 0)).drop("__fence"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a saved table of narrow rows for broadcast if its count is within the bound; else Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``edges`` (columns ``a``, ``b``, longs).

    Large-star and small-star steps in turn; each round is written, and the loop ends when a round changes nothing.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, last, k = scratch.save(e, f"{name}0"), None, 0
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last, k = state, k + 1
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        out = star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(star.select("u", "m")).where("u <> v").distinct()
        e = scratch.save(out, f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
    pairs = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return pairs.union(pairs.select("component", "component").distinct())
