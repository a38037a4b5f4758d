"""Structured Streaming ingest: new whole files are parsed and appended, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, value) of files as they arrive."""
    return spark.readStream.option("wholetext", "true").text(folder).select(F.col("_metadata.file_path").alias("doc"), "value")


def ingest(files: DataFrame, parse: Callable[[DataFrame], DataFrame], table: str, checkpoint: str) -> StreamingQuery:
    """Parses every batch of files and writes its rows under table/batch=<id>, overwriting only itself on a retry."""

    def append(batch: DataFrame, number: int) -> None:
        parse(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append).start()
