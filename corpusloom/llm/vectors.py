"""Shared reading of vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(c: str) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    x = F.col(c)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda e: e != 0), F.lit(False))


def doubles(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.col(c).cast("array<double>"))


def all_finite(c: str) -> Column:
    """Not null, and no null or non-finite component; zero and empty vectors are."""
    x = F.col(c)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(x.isNotNull() & finite, F.lit(False))


def floored(c: str, scale: int, most: int = 1 << 46) -> Column:
    """Array of floor(scale * component), the component as a double; one of ``most`` or more fails the query, as sums of its products could leave a long."""
    fits = lambda e: F.when(F.abs(e) * scale < most, F.floor(e * scale)).otherwise(F.raise_error(F.lit("a vector's component is too large")))
    return F.transform(F.col(c).cast("array<double>"), fits)


def usual_length(df: DataFrame, c: str) -> int:
    """The length that most vectors have, of equally many the larger; 0 without rows."""
    first = df.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return first["d"] if first else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a column of lists of d numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def summed(df: DataFrame, width: int) -> np.ndarray:
    """Sum over all rows of (pos, w), w an array of ``width`` numbers, by pos: a matrix whose size doesn't depend on the rows."""
    rows = df.groupBy("pos").agg(*[F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(width)]).collect()
    out = np.zeros((max((r["pos"] for r in rows), default=-1) + 1, width))
    for r in rows:
        out[r["pos"]] = r[1:]
    return out


def parts(total: np.ndarray) -> pa.RecordBatch:
    """A task's share of a sum, for ``summed``."""
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["pos", "w"])
