"""Sources: whole files, resource catalogues, JSON Lines and objects, optional and vector tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists; FileNotFoundError if none does."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def whole_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(doc, file_name, value): a row for each file of a folder, subfolders aside."""
    reader = spark.read.option("recursiveFileLookup", "false")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_name").alias("file_name"), "value")


def catalogue(spark: SparkSession, resources: dict[str, str]) -> DataFrame:
    """(name, path, present): named resources and whether they are there."""
    return spark.createDataFrame([(n, p, exists(spark, p)) for n, p in resources.items()], "name string, path string, present boolean")


def json_lines(spark: SparkSession, path: str | list[str], schema: str, mode: str = "PERMISSIVE") -> DataFrame:
    return spark.read.schema(schema).option("mode", mode).json(path)


def numbered_json_lines(spark: SparkSession, path: str, schema: str, name: str = "place") -> DataFrame:
    """Rows of one file of JSON Lines with their place in it, from 0 on.

    A task reads a block of the file from its start, so a row's place is the rows of the blocks before its own, of
    which there is one count each, and its place in its block. The file is read twice; no row is moved."""
    rows = json_lines(spark, path, schema).select("*", F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    blocks = rows.groupBy("_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("_start", "_first", F.coalesce(earlier, F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(blocks), "_start").withColumn(name, F.col("_before") + F.col("_id") - F.col("_first")).drop("_start", "_id", "_first", "_before")


def json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row; without the file, one row of nulls."""
    if exists(spark, path):
        return spark.read.schema(schema).option("multiLine", "true").json(path)
    return spark.createDataFrame([()], "struct<>").select(F.from_json(F.lit("{}"), schema).alias("o")).select("o.*")


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """JSON Lines if they are there."""
    return json_lines(spark, path, schema) if exists(spark, path) else None


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def vector_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def vector_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables in a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []
