"""Tables written to the folder every executor can reach.

Small intermediate tables (the item dictionary, the frequent sets of each level) are written
here rather than cached: their row ids must stay the same when an executor is lost and part of
a job runs again, and reading them back cuts the lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="itemweave-")


class Workspace:
    """One run's own sub-folder of the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        """Delete tables that no later read needs, or the whole folder if none is named."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in [self.path(name) for name in names] or [self.root]:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table read back."""
        schema = df.schema
        df.write.parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))
