"""Model inputs of fixed length: token ids by byte-pair merging, cut and padded, with mask and labels.

The model is a file of byte-level BPE in the JSON format of the public tokenizers library,
a few MB whatever the corpus is, broadcast and parsed once by each worker.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..shared import ship

MODEL = "/opt/tokenizers/byte_bpe_50k.json"
#: What a padded place of the labels holds, so that a loss leaves it out.
IGNORE = -100
#: Words whose ids a worker keeps, and the longest that it keeps.
KEPT, LONGEST = 200_000, 64
#: Fixed value: the words that byte-level models of this format cut text into.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _letters() -> dict[int, str]:
    """The character that a vocabulary of this format has for each byte: the byte's own where it prints, else the next from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts. Only plain byte-level models are taken; ValueError for others."""

    def __init__(self, raw: bytes):
        d = json.loads(raw)
        model, cut = d["model"], d["pre_tokenizer"] or {}
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or d["normalizer"] or any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges", "end_of_word_suffix", "continuing_subword_prefix")):
            raise ValueError("not a plain byte-level BPE model")
        vocabulary = model["vocab"]
        self.single = [vocabulary[c] for _, c in sorted(_letters().items())]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(vocabulary[a], vocabulary[b]): (i, vocabulary[a + b]) for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        self.known = lru_cache(KEPT)(self.word)

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of a word: the adjacent pair of lowest rank, leftmost of equals, merges until none can."""
        ids: list[int | None] = [self.single[b] for b in text.encode()]
        n = len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (found := self.rank.get((ids[i], ids[j]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            # What it was offered for may have merged since.
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.rank[a, b][1], None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
            offer(left[i], i)
            offer(i, k)
        return tuple(x for x in ids if x is not None)

    def first_ids(self, text: str, most: float) -> list[int]:
        """The first ids of a text; what comes after them is not looked at."""
        out: list[int] = []
        if most <= 0:
            return out
        for part in self.marks.splititer(text) if self.marks else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for m in self.words.finditer(part):
                    word = m[0]
                    out += self.known(word) if len(word) <= LONGEST else self.word(word)
                    if len(out) >= most:
                        break
            if len(out) >= most:
                return out[:most]
        return out


@lru_cache(2)
def _encoder(raw: bytes) -> Encoder:
    return Encoder(raw)


def _filled(encoder: Encoder, texts: pa.Array, starts: pa.Array | None, end: int | None, length: int, empty: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ids, empty where a text has ended, and how many each has."""
    out = np.full((len(texts), length), empty, np.int32)
    sizes = np.zeros(len(texts), np.int64)
    heads = starts.to_pylist() if starts is not None else [None] * len(texts)
    for i, (text, head) in enumerate(zip(texts, heads, strict=True)):
        ids = [] if head is None else [head]
        ids += encoder.first_ids(text.as_py() or "", length - len(ids) - (end is not None))
        if end is not None:
            ids.append(end)
        out[i, : len(ids)] = ids
        sizes[i] = len(ids)
    return out, sizes


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, length = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * length + 1, length, dtype=np.int32)), pa.array(rows.ravel()))


def encode_examples(df: DataFrame, source: str, target: str, pad: int, end: int | None = None, starts: tuple[str, str] | None = None, length: int = 128, ignore: int = IGNORE, model: str = MODEL) -> DataFrame:
    """df with ``input_ids``, ``attention_mask`` and ``labels``, arrays of the given length.

    A side is its start (an integer column of ``starts``, as a language's id), its text's tokens as far as they fit, and
    the end id, which a cut text keeps. Inputs are padded with pad and masked there, labels with ignore. Null texts
    count as empty, a null start as none. The strings of special tokens in texts are those tokens, as the library has it."""
    if length < (end is not None) + (starts is not None):
        raise ValueError(f"no room for start and end in {length} places")
    spark = df.sparkSession
    ship(spark)
    file = spark.sparkContext.broadcast(Path(model).read_bytes())
    places = [df.columns.index(c) for c in (source, target, *(starts or ()))]
    names = ("input_ids", "attention_mask", "labels")
    if clash := set(names) & set(df.columns):
        raise ValueError(f"df has {', '.join(sorted(clash))}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file.value)
        for b in batches:
            columns = ([b.column(i) for i in places] + [None, None])[:4]
            inputs, sizes = _filled(encoder, columns[0], columns[2], end, length, pad)
            labels, _ = _filled(encoder, columns[1], columns[3], end, length, ignore)
            mask = (np.arange(length) < sizes[:, None]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(_lists, (inputs, mask, labels))], [*b.schema.names, *names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in names]]))
