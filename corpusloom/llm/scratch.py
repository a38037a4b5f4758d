"""Shared intermediate tables.

Iterative operators cut their lineage with Parquet tables in the folder that the
cluster names in ``spark.checkpoint.dir``; a lost executor costs only the tasks it
ran, as the tables outlive it.
"""

from __future__ import annotations

import gc
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..shared import shared_folder


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when nothing else put it on their path."""
    home = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH", "")) if x)


class Scratch:
    """Tables of one operator call, in a folder of their own."""

    def __init__(self, spark: SparkSession, tag: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write df and read it again: the result has no lineage beyond its files."""
        at = self.path(name)
        df.write.parquet(at, compression=compression)
        back = self.spark.read.schema(df.schema).parquet(at)
        back._corpusloom_path = at
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            at = jvm.org.apache.hadoop.fs.Path(df._corpusloom_path)
            at.getFileSystem(conf).delete(at, True)

    def release(self) -> None:
        """Let Spark's cleaner delete shuffle files of plans that nothing refers to any more.

        The scheduler refers to the last job until another one ran."""
        gc.collect()
        self.spark.range(1).count()
        self.spark._jvm.System.gc()
        self.spark.range(1).count()
        self.spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
