"""Sinks: JSON Lines in order, as files or as one, small JSON objects, upserts by swap, versioned copies."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..shared import ship
from .readers import exists


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: Bytes that are copied at a time.
BUFFER = 1 << 22


def _parts(fs, folder) -> list[tuple[object, int]]:
    """(path, bytes) of a folder's part files, in the order of their numbers."""
    found = ((re.match(r"part-(\d+)", x.getPath().getName()), x) for x in fs.listStatus(folder))
    ordered = sorted(((int(m[1]), x.getPath().getName()), x) for m, x in found if m)
    return [(x.getPath(), x.getLen()) for _, x in ordered]


def _place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Copies each part into the target at its offset; a second attempt writes the same bytes to the same place."""
    for pdf in batches:
        for row in pdf.itertuples():
            at = os.open(row.target, os.O_CREAT | os.O_WRONLY, 0o644)
            try:
                with open(row.part, "rb") as source:
                    offset = row.offset
                    while block := source.read(BUFFER):
                        while block:
                            done = os.pwrite(at, block, offset)
                            offset, block = offset + done, block[done:]
                os.fsync(at)
            finally:
                os.close(at)
        yield pdf[["offset"]]


def _appended(spark: SparkSession, folder: str, path: str) -> None:
    """A folder's part files, one after the other, as one file beside path, then moved over it.

    Each part begins where those before it end, which their sizes say. On a mounted file system tasks copy
    the parts to their places. Elsewhere the file system joins files by their blocks if it can (HDFS does). If it
    can't (object stores), one stream copies them, block by block, as such a file has one writer."""
    fs, source = _fs(spark, folder)
    beside = f"{path}.{uuid.uuid4().hex}"
    target = _fs(spark, beside)[1]
    parts = _parts(fs, source)
    offsets = [0, *accumulate(size for _, size in parts)]
    if fs.getScheme() == "file" and parts:
        ship(spark)
        name = target.toUri().getPath()
        rows = [(name, part.toUri().getPath(), offset) for (part, _), offset in zip(parts, offsets, strict=False)]
        placed = spark.createDataFrame(rows, "target string, part string, offset long").repartition(len(rows), "offset")
        placed.mapInPandas(_place, "offset long").write.format("noop").mode("overwrite").save()
    else:
        fs.create(target, True).close()
        some = [part for part, size in parts if size]
        try:
            given = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(some))
            for i, part in enumerate(some):
                given[i] = part
            if some:
                fs.concat(target, given)
        except Py4JJavaError as e:
            if "UnsupportedOperationException" not in str(e.java_exception):
                raise
            _streamed(spark, fs, some, target)
    if fs.getFileStatus(target).getLen() != offsets[-1]:
        fs.delete(target, False)
        raise OSError(f"{path} should have {offsets[-1]} bytes")
    _moved_over(spark, beside, path)


def _streamed(spark: SparkSession, fs, parts: list, target) -> None:
    out = fs.create(target, True)
    try:
        for part in parts:
            into = fs.open(part)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(into, out, BUFFER, False)
            finally:
                into.close()
    finally:
        out.close()


def json_lines(df: DataFrame, path: str, order: list[str] | None = None, one_file: bool = False) -> None:
    """UTF-8, nulls written. Files follow the order by range.

    With one_file, path is one file: tasks write its parts beside it, each a range of the order, and the parts are put
    one after the other by their sizes. No task sorts it or holds it whole."""
    if order:
        df = df.orderBy(*order)
    if not one_file:
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
        return
    spark = df.sparkSession
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    try:
        df.write.option("ignoreNullFields", "false").json(parts)
        _appended(spark, parts, path)
    finally:
        fs, at = _fs(spark, parts)
        fs.delete(at, True)


def json_object(spark: SparkSession, path: str, value: dict) -> None:
    """A small object, indented, into one file."""
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    out.close()


def read_object(spark: SparkSession, path: str) -> dict:
    """The object of a file; empty without the file."""
    if not exists(spark, path):
        return {}
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def _moved_over(spark: SparkSession, beside: str, path: str) -> None:
    """Moves what is beside to path; what was there goes only when that is done, and comes back if it fails."""
    fs, at = _fs(spark, path)
    new, old = _fs(spark, beside)[1], _fs(spark, f"{path}.old-{uuid.uuid4().hex}")[1]
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        raise OSError(f"can't move {path}")
    if not fs.rename(new, at):
        if had:
            fs.rename(old, at)
        raise OSError(f"can't move {beside} to {path}")
    if had:
        fs.delete(old, True)


def upsert_object(spark: SparkSession, path: str, values: dict) -> dict:
    """Sets keys of a file's object: written beside it, then moved over it."""
    merged = read_object(spark, path) | values
    beside = f"{path}.{uuid.uuid4().hex}"
    json_object(spark, beside, merged)
    _moved_over(spark, beside, path)
    return merged


def upsert_table(df: DataFrame, path: str, keys: list[str]) -> None:
    """Rows of df replace the table's rows of equal keys; written beside the table, then moved over it."""
    spark = df.sparkSession
    if exists(spark, path):
        df = spark.read.parquet(path).join(df.select(*keys), keys, "left_anti").unionByName(df)
    beside = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(beside)
    _moved_over(spark, beside, path)


def keep_version(spark: SparkSession, path: str, stamp: str) -> str | None:
    """Moves what is at path to a name with the stamp; nothing if there is nothing. OSError if it can't be moved."""
    if not exists(spark, path):
        return None
    fs, at = _fs(spark, path)
    if not fs.rename(at, _fs(spark, f"{path}.{stamp}")[1]):
        raise OSError(f"can't move {path}")
    return f"{path}.{stamp}"


def backup(spark: SparkSession, path: str, stamp: str) -> str | None:
    """Copies what is at path to a name with the stamp and leaves it there; nothing if there is nothing. OSError if it can't be copied."""
    if not exists(spark, path):
        return None
    fs, at = _fs(spark, path)
    kept = f"{path}.{stamp}"
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at, fs, _fs(spark, kept)[1], False, True, spark.sparkContext._jsc.hadoopConfiguration()):
        raise OSError(f"can't copy {path} to {kept}")
    return kept
