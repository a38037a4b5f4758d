"""Rows that meet all rows of another table, in shards held by a task while the others stream past."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import ship

S = TypeVar("S")


def passed(held: DataFrame, asked: DataFrame, deal: Column, hold: Callable[[pa.RecordBatch], S], meet: Callable[[S, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType, shard: int = 50_000) -> DataFrame:
    """What ``meet`` yields for every batch of asked and every shard of held.

    Rows of held are dealt into shards of about so many rows, at least one for each core,
    by a hash of ``deal`` (which should tell rows apart); each moves once. Rows of asked are copied
    to every shard. A task gets one shard, its held rows first: ``hold`` makes of them what stays in memory, and asked
    rows go past it batch by batch. So memory is bounded by a shard, whatever is asked."""
    spark = held.sparkSession
    ship(spark)
    shards = max(spark.sparkContext.defaultParallelism, math.ceil(held.count() / shard))
    whole = lambda df: F.struct(*df.columns)
    none = lambda df: F.lit(None).cast(df.schema.simpleString())
    left = held.select(F.pmod(F.xxhash64(deal), F.lit(shards)).cast("int").alias("s"), whole(held).alias("h"), none(asked).alias("a"))
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), none(held).alias("h"), whole(asked).alias("a"))
    dealt = left.unionByName(right).repartitionById(shards, F.col("s")).sortWithinPartitions(F.col("a").isNotNull()).select("h", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.Array] = []
        state = None
        for b in batches:
            h, a = b.column(0).drop_null(), b.column(1).drop_null()
            if len(h):
                rows.append(h)
            if len(a):
                if state is None:
                    state = (hold(pa.RecordBatch.from_struct_array(pa.concat_arrays(rows or [h]))),)
                    rows = []
                yield from meet(state[0], pa.RecordBatch.from_struct_array(a))

    return dealt.mapInArrow(run, schema)


def vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the vectors of a column of lists, for each length that occurs."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        part = column if len(at) == len(column) else column.take(pa.array(at))
        yield int(d), at, part.flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(d))


def firsts(group: np.ndarray, n: int) -> np.ndarray:
    """Which entries of a sorted array are among the first n of their value."""
    starts = np.searchsorted(group, group, "left")
    return np.arange(len(group)) - starts < n
