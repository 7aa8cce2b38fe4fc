"""Intermediate tables in the shared folder of the cluster.

A table written here survives the loss of any executor, and cuts the lineage of
what reads it. The folder is ``spark.checkpoint.dir``. Only a session of a single
process (master local, as in tests) may leave it unset, and gets a temporary
folder; on a cluster that is an error, as machines do not share such a folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables of one run of one operator, each in a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.saved: list[str] = []

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        """Write df and read it again."""
        df.write.parquet(self.path(table))
        self.saved.append(table)
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def save_counted(self, df: DataFrame, table: str) -> tuple[DataFrame, int]:
        """Write df and read it again; also its number of rows, counted as they are written."""
        seen = Observation()
        return self.save(df.observe(seen, F.count(F.lit(1)).alias("n")), table), seen.get.get("n", 0)

    def drop(self, *tables: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_all_but(self, *tables: str) -> None:
        """Delete all other tables that were saved here."""
        self.drop(*(t for t in self.saved if t not in tables))
        self.saved = [t for t in self.saved if t in tables]

    def clear(self) -> None:
        """Delete all that was written here."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.saved = []
