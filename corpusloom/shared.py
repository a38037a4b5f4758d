"""Results that a plan reads more than once and that must not be computed anew."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach: the one in spark.checkpoint.dir.

    Where the setting is missing (tests on a local master) a temporary folder stands
    in; any other master is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
    return spark.sparkContext.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when nothing else put it on their path."""
    home = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH", "")) if x)


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder."""
    ship(df.sparkSession)
    shared_folder(df.sparkSession)
    return df.checkpoint()
