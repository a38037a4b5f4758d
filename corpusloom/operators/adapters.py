"""External models behind protocols; workers run them in Arrow batches. The stand-ins here are deterministic."""

from __future__ import annotations

import hashlib
import logging
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import LANGUAGE_CODES
from ..functions.text import strip
from ..shared import ship
from .prompt import prompt, refinement

DIRECTIONS = ("inga2es", "es2inga")


class Embedder(Protocol):
    def __call__(self, texts: list[str], task: str) -> list[list[float]]: ...


class Translator(Protocol):
    def __call__(self, prompts: list[str], direction: str) -> list[str]: ...


class HashEmbedder:
    """A unit vector from hashed words; asymmetric tasks share it."""

    def __init__(self, width: int = 768):
        self.width = width

    def __call__(self, texts: list[str], task: str) -> list[list[float]]:
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
                row[h % self.width] += 1 if h >> 63 else -1
        return (out / np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))).tolist()


def retried(call: Callable, attempts: int = 5, first_wait: float = 5.0, sleep: Callable[[float], None] = time.sleep):
    """call, again after doubling waits when the service says that its quota is used up; other errors are raised."""

    def run(*args):
        for n in range(attempts):
            try:
                return call(*args)
            except Exception as e:
                if n + 1 == attempts or not ("429" in str(e) or "RESOURCE_EXHAUSTED" in str(e)):
                    raise
                sleep(first_wait * 2**n)

    return run


def _mapped(df: DataFrame, name: str, kind: T.DataType, of: Callable[[pd.DataFrame], list], batch: int) -> DataFrame:
    ship(df.sparkSession)
    kept = df.drop(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                yield part.assign(**{name: of(part)})

    return kept.mapInPandas(run, T.StructType([*kept.schema.fields, T.StructField(name, kind)]))


def embed(df: DataFrame, text: str, embedder: Embedder, task: str = "RETRIEVAL_QUERY", batch: int = 50) -> DataFrame:
    """df with ``vector`` of a text column."""
    return _mapped(df, "vector", T.ArrayType(T.FloatType()), lambda p: embedder(p[text].fillna("").tolist(), task), batch)


def check_direction(direction: str) -> tuple[str, str]:
    """Source and target codes; ValueError for an unknown direction."""
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction: {direction}")
    a, b = direction.split("2")
    return LANGUAGE_CODES[a], LANGUAGE_CODES[b]


def translate(df: DataFrame, prompt: str, direction: str, translator: Translator, out: str = "hyp", batch: int = 8) -> DataFrame:
    """df with the translator's answers to a prompt column."""
    check_direction(direction)
    return _mapped(df, out, T.StringType(), lambda p: translator(p[prompt].fillna("").tolist(), direction), batch)


def _calls(spark: SparkSession, store: str) -> list[str]:
    """Folders of answers of the calls that came to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [x.getPath().getParent().toString() for x in found or ()]


def answered(df: DataFrame, prompt: str, direction: str, translator: Translator, store: str, out: str = "hyp", batch: int = 8) -> DataFrame:
    """df with the translator's answers, each distinct prompt asked once and its answer kept in the table at ``store``.

    Prompts that have an answer there are not asked again; those that fail have none and are asked
    by the next call. Answers are kept per direction and whole prompt. Null prompts count as empty."""
    check_direction(direction)
    spark = df.sparkSession
    ship(spark)
    text = F.coalesce(F.col(prompt), F.lit(""))
    asked = df.select(text.alias("prompt")).distinct().withColumns({"direction": F.lit(direction), "hash": F.xxhash64("prompt")})
    kind = "direction string, hash long, prompt string, answer string"
    # Each call adds a folder: Spark takes two reads of one folder for the same, whatever was added between them.
    if earlier := _calls(spark, store):
        asked = asked.join(spark.read.schema(kind).parquet(*earlier), ["direction", "hash", "prompt"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                try:
                    yield part.assign(answer=translator(part["prompt"].tolist(), direction))
                except Exception as e:
                    # The rest of the answers is worth keeping; the call is made again with what is missing.
                    logging.getLogger(__name__).warning("a batch of %d prompts failed: %s", len(part), e)

    fresh = asked.select("direction", "hash", "prompt").mapInPandas(run, kind)
    fresh.write.parquet(f"{store}/{uuid.uuid4().hex}")
    known = spark.read.schema(kind).parquet(*_calls(spark, store)).where(F.col("direction") == direction).select(F.col("hash").alias("_hash"), F.col("prompt").alias("_prompt"), F.col("answer").alias(out)).dropDuplicates(["_hash", "_prompt"])
    kept = df.drop(out).withColumns({"_key": text, "_h": F.xxhash64(text)})
    return kept.join(known, (F.col("_h") == F.col("_hash")) & (F.col("_key") == F.col("_prompt")), "left").drop("_h", "_hash", "_key", "_prompt")


def refine(drafts: DataFrame, prompt: str, draft: str, direction: str, translator: Translator, store: str, out: str = "refined") -> DataFrame:
    """drafts with the answers to their prompts followed by their drafts, white space at the ends stripped; rows without a draft get null."""
    asked = drafts.withColumn("_ask", refinement(F.col(prompt), F.col(draft)))
    some = answered(asked.where("_ask is not null"), "_ask", direction, translator, store, out).withColumn(out, strip(F.col(out)))
    none = asked.where("_ask is null").withColumn(out, F.lit(None).cast("string"))
    return some.unionByName(none).drop("_ask")


def _parsed(name: str, kind: str) -> Column:
    return F.transform(F.col(name), lambda r: F.from_json(r, kind)).alias(name)


def translate_with_retrieval(sentences: DataFrame, direction: str, indexes: dict[str, DataFrame], embedder: Embedder, translator: Translator, top_k: int = 5, use_context: bool = True) -> DataFrame:
    """sentences(query_id, sentence) with ``hyp``: the context is retrieved, the prompt built and answered, white space at the ends stripped.

    Examples come from the index of the direction's source side (ejemplos or ejemplos_es)."""
    from .vector import retrieve

    check_direction(direction)
    asked = sentences
    if use_context:
        examples = "ejemplos" if direction == "inga2es" else "ejemplos_es"
        kinds = {"lexico": "lema string, cat string, glosa string", "gramatical": "fuente string, text string", examples: "texto_inga string, texto_es string"}
        queries = embed(sentences, "sentence", embedder).select("query_id", F.col("vector").alias("query_vector"))
        found = retrieve({k: indexes[k] for k in kinds}, queries, top_k).drop("total")
        records = [_parsed(k, kind) for k, kind in kinds.items()]
        asked = sentences.join(found.select("query_id", *records), "query_id", "left")
        context = {"lexicon": F.col("lexico"), "grammar": F.col("gramatical"), "examples": F.col(examples)}
        asked = asked.withColumn("_prompt", prompt(F.col("sentence"), direction, **context)).drop(*kinds)
    else:
        asked = asked.withColumn("_prompt", prompt(F.col("sentence"), direction))
    return translate(asked, "_prompt", direction, translator).withColumn("hyp", strip(F.col("hyp"))).drop("_prompt")
