"""Profiles and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count


def document_profile(x: Column) -> list[Column]:
    """Characters, words, lines and page marks of a text."""
    return [F.length(x).cast("long").alias("chars"), word_count(x).cast("long").alias("words"), (F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"), F.regexp_count(x, F.lit("<!-- Page ")).cast("long").alias("pages")]


def counts(df: DataFrame, key: str) -> DataFrame:
    """Rows by key, null keys dropped."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """(bin, low, n) of equal widths between the least and the largest value, which falls into the last bin."""
    ends = df.agg(F.min(value).cast("double").alias("a"), F.max(value).cast("double").alias("z"))
    rows = df.select(F.col(value).cast("double").alias("v")).where("v is not null").crossJoin(F.broadcast(ends))
    width = (F.col("z") - F.col("a")) / bins
    at = F.when(F.col("z") == F.col("a"), 0).otherwise(F.least(F.floor(F.try_divide(F.col("v") - F.col("a"), width)), F.lit(bins - 1)))
    return rows.groupBy(at.cast("int").alias("bin"), (F.col("a") + at * width).alias("low")).agg(F.count("*").alias("n"))


def contingency(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """Counts of each value by key, 0 where none."""
    return df.groupBy(key).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def coverage(canon: DataFrame, found: DataFrame, key: str, expected: str, floor: float = 90.0) -> DataFrame:
    """(key, canon, n, percent, low) by key with a TOTAL row: counts of found against the expected ones."""
    joined = canon.select(key, expected).join(counts(found, key), key, "left").select(key, F.col(expected).cast("long").alias("canon"), F.coalesce("n", F.lit(0)).alias("n"))
    rolled = joined.rollup(key).agg(F.sum("canon").alias("canon"), F.sum("n").alias("n"), F.grouping(key).alias("g"))
    percent = F.try_divide(F.col("n") * 100.0, F.col("canon"))
    return rolled.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col(key)).alias(key), "canon", "n", percent.alias("percent"), F.coalesce(percent < floor, F.lit(False)).alias("low"))
