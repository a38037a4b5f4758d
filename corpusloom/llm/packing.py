"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents are dealt into groups of bounded size by a hash of their id, and each group
is packed by itself, longest item first:

* an item goes to the open bin with the least room that still holds it (best fit);
* if none holds it, a bin of the permitted length with the least cost is opened. A
  sequence costs its tokens, a share of them that grows with its length (attention is
  quadratic: length / attention), and a fixed part (per_bin); the least cost for each
  token that the bin can be expected to hold, min(length, tokens not placed yet), wins.
  So short items open middling bins, long ones the length that they need;
* at the end every bin shrinks to the shortest permitted length that holds its contents.

An item longer than the longest length is cut into pieces, all of them placed. Null and
empty texts have no tokens and get one row with null bin columns. Null ids are items like
others. Repeated rows are items of their own; ties go by (doc_id, copy, piece). An empty
table gives no rows. Extra columns are ignored. Rows are dealt into groups by a hash of
their id and place in the input, so that repeated rows spread: a group holds about
``group_docs`` of them, memory doesn't grow with the table, and a lost executor's groups
are packed again to the same bins.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch as S
from .textbytes import blocks, word_spans

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Fixed cost of a sequence, in tokens, and the length at which attention costs as much as all the rest.
PER_BIN, ATTENTION = 64, 32_768
OUT = "doc_id long, piece int, piece_tokens long, bin_id string, bin_length int, bin_offset int, bin_tokens int"


def cost(length: int, per_bin: int = PER_BIN, attention: int = ATTENTION) -> float:
    """Of one sequence."""
    return length + length * length / attention + per_bin


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, per_bin: int = PER_BIN, attention: int = ATTENTION) -> tuple[list[tuple[int, int]], list[int]]:
    """((bin, offset) of each size, length of each bin). Sizes are between 1 and the longest length.

    Larger sizes first, equal ones by place. Open bins are kept sorted by room, so each
    size costs a binary search."""
    lengths = tuple(sorted(lengths))
    left = sum(sizes)
    place: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    held: list[int] = []
    opened: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        size = sizes[i]
        k = bisect_left(room, (size, -1))
        if k < len(room):
            _, b = room.pop(k)
        else:
            best = min((x for x in lengths if x >= size), key=lambda x: (cost(x, per_bin, attention) / min(x, left), x))
            b = len(opened)
            opened.append(best)
            held.append(0)
        place[i] = (b, held[b])
        held[b] += size
        left -= size
        if opened[b] > held[b]:
            insort(room, (opened[b] - held[b], b))
    return place, [next(x for x in lengths if x >= h) for h in held]


def count_words(documents: DataFrame) -> DataFrame:
    """doc_id, n_tokens: words between ASCII white space in the whole text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            for lo, hi, data, offsets in blocks(b.column(1)):
                n[lo:hi] = np.bincount(word_spans(data, offsets)[2], minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], ["doc_id", "n_tokens"])

    S.ship(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(counted, "doc_id long, n_tokens long")


def pack_table(sized: DataFrame, lengths: tuple[int, ...] = LENGTHS, per_bin: int = PER_BIN, group_docs: int = 20_000, n_docs: int | None = None) -> DataFrame:
    """One row for each piece of each row of sized(doc_id, n_tokens)."""
    n = sized.count() if n_docs is None else n_docs
    groups = max(1, math.ceil(n / group_docs))
    longest = max(lengths)

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable", na_position="first")
        tokens = pdf["n_tokens"].fillna(0).to_numpy(np.int64)
        pieces = np.maximum(1, -(-tokens // longest))
        row = np.repeat(np.arange(len(pdf)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(longest, tokens[row] - piece * longest)
        full = np.flatnonzero(size > 0)
        place, length = pack(size[full].tolist(), lengths, per_bin)
        out = pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[row], "piece": piece.astype(np.int32), "piece_tokens": size})
        b = np.array([p[0] for p in place], np.int64)
        used = np.bincount(b, size[full], minlength=len(length)).astype(np.int64) if len(b) else np.zeros(0, np.int64)
        for name, kind in (("bin_id", object), ("bin_length", "Int32"), ("bin_offset", "Int32"), ("bin_tokens", "Int32")):
            out[name] = pd.Series([None] * len(out), dtype=kind)
        if len(full):
            out.loc[full, "bin_id"] = [f"{int(key[0])}-{x}" for x in b]
            out.loc[full, "bin_length"] = np.array(length, np.int64)[b]
            out.loc[full, "bin_offset"] = [p[1] for p in place]
            out.loc[full, "bin_tokens"] = used[b]
        return out

    S.ship(sized.sparkSession)
    keyed = sized.select(F.col("doc_id").cast("long"), F.col("n_tokens").cast("long"), F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.monotonically_increasing_id()), F.lit(groups)).alias("g"))
    return keyed.groupBy("g").applyInPandas(packed, OUT)


def pack_documents(documents: DataFrame, lengths: tuple[int, ...] = LENGTHS, per_bin: int = PER_BIN, group_docs: int = 20_000) -> DataFrame:
    return pack_table(count_words(documents), lengths, per_bin, group_docs, documents.count())
