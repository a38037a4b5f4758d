"""Vector tables and exact retrieval by squared L2 distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .adapters import Embedder, embed
from .passing import firsts, passed, vectors


def squared_distance(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diff, F.lit(0.0), lambda s, d: s + d)


def build_index(records: DataFrame, text: str, embedder: Embedder, path: str) -> int:
    """Embeds a text column and writes the table; raises ValueError without records."""
    if records.isEmpty():
        raise ValueError("an index needs records")
    embed(records, text, embedder, "RETRIEVAL_DOCUMENT").write.mode("overwrite").parquet(path)
    return records.sparkSession.read.parquet(path).count()


#: Products of queries and index rows that a task holds at once.
PRODUCTS = 1 << 21


def _held(key: str):
    """A shard: its rows, the order of their keys, and by length of the vectors (places, matrix, squared norms)."""

    def run(rows: pa.RecordBatch) -> tuple:
        order = np.unique(rows.column(rows.schema.get_field_index(key)).to_numpy(zero_copy_only=False), return_inverse=True)[1]
        found = {}
        for d, at, x in vectors(rows.column(rows.schema.get_field_index("vector"))):
            x = x.astype(np.float64)
            found[d] = at, x, (x * x).sum(1)
        return rows.drop_columns(["vector"]), order, found

    return run


def _nearest(k: int, query_key: str):
    """The k nearest of a shard's rows for each query of a batch.

    Products and norms give distances up to rounding; what lies within its bound of the
    k-th is measured again, component by component."""

    def run(shard: tuple, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, order, by_length = shard
        ids = asked.column(asked.schema.get_field_index(query_key))
        for d, places, q in vectors(asked.column(asked.schema.get_field_index("query_vector"))):
            if d not in by_length:
                continue
            at, x, norm = by_length[d]
            step = max(1, PRODUCTS // len(x))
            for lo in range(0, len(q), step):
                part = q[lo : lo + step].astype(np.float64)
                own = (part * part).sum(1)[:, None]
                near = norm + own - 2 * part @ x.T
                slack = 8 * (d + 4) * np.finfo(float).eps * (norm + own)
                # The k-th of what distances can be at most bounds those that matter.
                cut = np.partition(near + slack, k - 1, axis=1)[:, k - 1 : k] if len(x) > k else np.inf
                i, j = np.nonzero(near - slack <= cut)
                some = max(1, PRODUCTS // max(1, d))
                exact = np.concatenate([((x[j[a : a + some]] - part[i[a : a + some]]) ** 2).sum(1) for a in range(0, len(i), some)])
                best = np.lexsort((order[at[j]], exact, i))
                best = best[firsts(i[best], k)]
                yield pa.RecordBatch.from_arrays([*rows.take(pa.array(at[j[best]])).columns, ids.take(pa.array(places[lo + i[best]])), pa.array(exact[best])], [*rows.schema.names, query_key, "distance"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 5, key: str = "id", query_key: str = "query_id") -> DataFrame:
    """The k nearest rows of index(key, vector) for each of queries(query_key, query_vector).

    The index is dealt into shards once and queries stream past them (see ``passed``); only
    a shard's k best of each query go on to the merge. Rows and queries whose vectors are null
    or hold nulls take no part; a query meets vectors of its own length."""
    whole = lambda c: F.col(c).isNotNull() & F.forall(c, lambda e: e.isNotNull())
    index, queries = index.where(whole("vector")), queries.select(query_key, "query_vector").where(whole("query_vector"))
    fields = [f for f in index.schema.fields if f.name != "vector"]
    schema = StructType([*fields, queries.schema[query_key], StructField("distance", DoubleType())])
    found = passed(index, queries, F.struct(key, "vector"), _held(key), _nearest(k, query_key), schema)
    near = Window.partitionBy(query_key).orderBy("distance", key)
    return found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)


def search_one(index: DataFrame, vector: list[float], k: int = 5, key: str = "id") -> DataFrame:
    """The k nearest rows to one vector: a top-k without a shuffle of all rows."""
    query = F.array(*[F.lit(float(v)) for v in vector])
    return index.withColumn("distance", squared_distance(F.col("vector"), query)).drop("vector").orderBy("distance", key).limit(k)


def retrieve(indexes: dict[str, DataFrame], queries: DataFrame, k: int = 5, key: str = "id") -> DataFrame:
    """(query_id, one array of records for each index, total): all indexes searched with vectors embedded once."""
    found = None
    for name, index in indexes.items():
        got = search(index, queries, k, key).withColumn("record", F.to_json(F.struct(*[c for c in index.columns if c != "vector"]))).select("query_id", F.lit(name).alias("index_name"), "rank", "record")
        found = got if found is None else found.unionByName(got)
    arrays = [F.transform(F.array_sort(F.collect_list(F.when(F.col("index_name") == n, F.struct("rank", "record")))), lambda x: x["record"]).alias(n) for n in indexes]
    return found.groupBy("query_id").agg(*arrays, F.count("*").alias("total"))


def retrieve_by_direction(index: DataFrame, queries: DataFrame, routes: dict[str, str], k: int = 5, key: str = "id") -> DataFrame:
    """As search(), in the part of index(index_name, ...) that each query's direction routes to."""
    found = [search(index.where(F.col("index_name") == name), queries.where(F.col("direction") == way), k, key).withColumn("direction", F.lit(way)) for way, name in routes.items()]
    return reduce(DataFrame.unionByName, found)


def index_sizes(spark: SparkSession, paths: dict[str, str]) -> dict[str, int]:
    return {name: spark.read.parquet(p).count() for name, p in paths.items()}


def index_records(lexicon: DataFrame, grammar: DataFrame, examples: DataFrame) -> dict[str, DataFrame]:
    """The records of the four indexes, each with the text that is embedded: dictionary entries, grammar chunks, and examples by either side."""
    entry = F.trim(F.concat(F.coalesce("lema", F.lit("")), F.lit(" ("), F.coalesce("cat", F.lit("")), F.lit("): "), F.coalesce("glosa", F.lit(""))))
    pair = lambda side: examples.select(F.col(side).alias("text"), "texto_inga", "texto_es", "libro", F.col("capitulo").cast("int").alias("capitulo"), F.col("versiculo").cast("int").alias("versiculo"))
    return {"lexico": lexicon.select(entry.alias("text"), "lema", "cat", "glosa"), "gramatical": grammar.select("text", "fuente", "chunk_id"), "ejemplos": pair("texto_inga"), "ejemplos_es": pair("texto_es")}
