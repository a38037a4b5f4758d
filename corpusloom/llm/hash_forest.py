"""Approximate nearest neighbours by largest inner product: a hash-prefix forest.

Rows are dealt into shards of bounded size by a hash of their id, and every row is
indexed. A shard's rows are split into bands whose norms differ by at most a factor of
``BAND``, so that short vectors do not crowd at one axis. A band holds ``trees`` sorted
arrays of ``bits``-long hash strings. Inner product becomes an angle by one more
component: x is scaled by the largest norm M of the band and extended by sqrt(1 - |x|^2 / M^2), a query by 0; each bit is the sign of
a product with a random direction. A query descends in each tree to its longest prefix
match by binary search. Then all trees ascend together: prefix lengths fall level by
level until the prefix ranges of all trees hold ``support`` entries for each row that is
to be scored, which are ``share`` of the band's rows (at least ``least``): the rows that
most trees hold in their ranges. These are scored exactly, in double precision. A band of
at most ``least`` rows is scored whole. Bands go from the longest vectors down; a query
leaves out those that cannot reach its ``k`` best, as no product exceeds that of the norms.

Queries are rows whose id is divisible by ``every``; in blocks they meet every shard.
Per shard and query the ``k`` best go on to the merge. Null, empty, zero and non-finite
vectors, vectors of other lengths than the query's and rows without an id take no part;
rows that repeat a query's id are no candidates of it; other repeated rows are candidates
each; queries that share an id share its 20 places. Ties go to the smaller vec_id.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .vectors import doubles, valid

SHARD, QUERIES = 16_384, 16_384
#: Largest quotient of two norms in a band.
BAND = 1.25


class Forest:
    """The sorted hash strings of one band's rows."""

    def __init__(self, x: np.ndarray, most: float, trees: int, bits: int, seed: int = 17):
        self.trees, self.bits = trees, bits
        rng = np.random.default_rng(seed)
        self.planes = rng.normal(size=(x.shape[1] + 1, trees * bits))
        lift = np.sqrt(np.maximum(0.0, 1 - ((x / most) ** 2).sum(1)))
        self.codes = self._codes(np.column_stack((x / most, lift)))
        self.order = np.argsort(self.codes, axis=1, kind="stable")
        self.codes = np.take_along_axis(self.codes, self.order, axis=1)

    def _codes(self, z: np.ndarray, rows: int = 2048) -> np.ndarray:
        weights = (1 << np.arange(self.bits - 1, -1, -1)).astype(np.float64)
        out = np.empty((self.trees, len(z)), np.int64)
        for lo in range(0, len(z), rows):
            signs = (z[lo : lo + rows] @ self.planes > 0).reshape(-1, self.trees, self.bits)
            out[:, lo : lo + rows] = (signs @ weights).T
        return out

    def candidates(self, q: np.ndarray, enough: int, support: int) -> list[np.ndarray]:
        """For each query ``enough`` rows at most: those in most ranges, at the longest prefixes whose ranges hold ``support`` times as many entries."""
        codes = self._codes(np.column_stack((q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q)))))
        n = self.codes.shape[1]
        enough = min(enough, n)
        out: list[np.ndarray] = [np.arange(n)] * len(q)
        open_ = np.arange(len(q))
        for length in range(self.bits, 0, -1):
            shift = self.bits - length
            a, z = np.empty((self.trees, len(open_)), np.int64), np.empty((self.trees, len(open_)), np.int64)
            for t in range(self.trees):
                prefix = codes[t, open_] >> shift
                a[t] = np.searchsorted(self.codes[t], prefix << shift, "left")
                z[t] = np.searchsorted(self.codes[t], (prefix + 1) << shift, "left")
            done = (z - a).sum(0) >= enough * support
            for i in np.flatnonzero(done):
                held = np.bincount(np.concatenate([self.order[t, a[t, i] : z[t, i]] for t in range(self.trees)]), minlength=n)
                out[open_[i]] = np.sort(np.argpartition(-held, enough - 1)[:enough])
            open_ = open_[~done]
            if not len(open_):
                break
        return out


def _bands(norm: np.ndarray) -> Iterator[np.ndarray]:
    """Rows by falling norm, cut where BAND is exceeded."""
    order = np.argsort(-norm, kind="stable")
    lo = 0
    while lo < len(order):
        hi = int(np.searchsorted(-norm[order], -norm[order[lo]] / BAND, "right"))
        yield order[lo:hi]
        lo = hi


def _search(k: int, trees: int, bits: int, share: float, least: int, support: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby(pdf["embedding"].map(len)):
            rows, asked = part[~part["is_query"]], part[part["is_query"]]
            if not len(rows) or not len(asked):
                continue
            ids, qid = rows["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
            x, q = np.stack(rows["embedding"].to_numpy()), np.stack(asked["embedding"].to_numpy())
            norm, asked_norm = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
            best = [np.zeros(0, np.int64)] * len(q)
            kth = np.full(len(q), -np.inf)
            for rows_in in _bands(norm):
                most = norm[rows_in[0]]
                left = np.flatnonzero(most * asked_norm * (1 + 1e-9) >= kth)
                if not len(left):
                    break
                enough = max(least, math.ceil(share * len(rows_in)))
                if len(rows_in) <= enough:
                    met = [rows_in] * len(left)
                else:
                    met = [rows_in[m] for m in Forest(x[rows_in], most, trees, bits).candidates(q[left], enough, support)]
                for i, found in zip(left, met, strict=True):
                    found = np.concatenate((best[i], found[ids[found] != qid[i]]))
                    score = x[found] @ q[i]
                    if len(found) > k:
                        cut = np.partition(score, len(score) - k)[len(score) - k]
                        found = found[score >= cut - 1e-9 * (1 + abs(cut))]
                        kth[i] = cut
                    best[i] = found
            for i, found in enumerate(best):
                exact = (x[found] * q[i]).sum(1)
                top = np.lexsort((ids[found], -exact))[:k]
                out.append(pd.DataFrame({"query_id": qid[i], "vec_id": ids[found][top], "score": exact[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, trees: int = 256, bits: int = 20, share: float = 0.18, least: int = 256, support: int = 16, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score."""
    spark = embeddings.sparkSession
    sc = Scratch(spark, "forest")
    rows = doubles(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "embedding").where(valid("embedding") & F.col("vec_id").isNotNull())
    n, asked = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    shards, blocks = max(1, math.ceil(n / shard)), max(1, math.ceil(asked / QUERIES))
    of = lambda m, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")
    all_ = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    held = rows.select(of(shards, 1).alias("s"), all_(blocks).alias("b"), F.lit(False).alias("is_query"), "vec_id", "embedding")
    # A query row that is repeated is one query; candidate rows are all kept.
    query = rows.where(F.col("vec_id") % every == 0).distinct().select(all_(shards).alias("s"), of(blocks, 2).alias("b"), F.lit(True).alias("is_query"), "vec_id", "embedding")
    found = held.unionByName(query).groupBy("s", "b").applyInPandas(_search(k, trees, bits, share, least, support), "query_id long, vec_id long, score double")
    found = sc.save(found, "found")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: np.ndarray, x: np.ndarray, k: int, every: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query id, its k nearest ids), to measure recall."""
    for i in np.flatnonzero(ids % every == 0):
        score = (x * x[i]).sum(1)
        other = np.flatnonzero(ids != ids[i])
        yield int(ids[i]), ids[other][np.lexsort((ids[other], -score[other]))[:k]]
