"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells.

1. Equal vectors of one label are one row with a count, so a vector in a third of all
   rows is compared once.
2. Spherical k-means is fitted on a bounded sample (``SAMPLE`` vectors with the smallest
   hash); its centres are unit vectors. Their number is doubled from 2 on as long as the
   products and copies that the sample would need become fewer.
3. Each vector has its home in the cell of its nearest centre c*, and visits every
   other cell c where a partner could live: with unit vectors x, y and x . y >= t, x is
   nearer to c than to c* only if y . (c* - c) <= sqrt(1 - t^2) |c* - c|. So all
   partners of a vector are in its home cell, at home or visiting: no pair is lost.
4. Cells of a label are cut into blocks; a task multiplies one block of those at home
   with one block of all in the cell, counts links, and emits only a spanning set.

Labels that differ, null labels, and vectors that are null, empty, zero or hold null or
non-finite components link with nothing. Vectors of different lengths never link. Ties
and repeated vectors: copies link with each other; rows that repeat a vec_id count as
other vectors, each with the links of its own vector, but are one node. Rows with a null
vec_id count no links and get a null component. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import Scratch
from .vectors import doubles, valid

SAMPLE = 20_000
#: Fewest vectors of the largest label for each cell, the most cells, and vectors in a block.
CELL, MOST_CELLS, BLOCK = 16, 1024, 2048
#: Cost of a copy of a vector in a cell, in products with a thousandth of a label's vectors.
COPY = 20


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k unit centres of the rows of x (unit vectors); empty cells take the vector that fits worst."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        sim = x @ centres.T
        cell = sim.argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, cell, x)
        norm = np.linalg.norm(total, axis=1)
        for c in np.flatnonzero(norm < 1e-12):
            worst = int(sim.max(1).argmin())
            total[c], norm[c] = x[worst], 1.0
            sim[worst] = 1.0
        centres = total / norm[:, None]
    return centres


def best_centres(x: np.ndarray, most: int, threshold: float) -> np.ndarray:
    """Centres of unit vectors x: as many as leave fewest products of those at home in a cell with those that visit it."""
    best, least = x[:1], math.inf
    k = min(2, most)
    while k <= most:
        centres = spherical_kmeans(x, k)
        home, visit = cells_of(x, centres, threshold)
        visits = visit.sum(0)
        work = float(np.bincount(home, minlength=len(centres)) @ visits) / len(x) ** 2 + COPY / 1000 * float(visits.sum()) / len(x)
        if work >= least:
            break
        best, least = centres, work
        k *= 2
    return best


def cells_of(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(home of each unit vector, whether it must visit each cell, its home included)."""
    sim = x @ centres.T
    home = sim.argmax(1)
    gap = np.linalg.norm(centres[:, None] - centres[None], axis=2) if len(centres) <= 256 else np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    margin = math.sqrt(max(0.0, 1 - threshold**2)) * gap[home] + 1e-9
    return home, sim[np.arange(len(x)), home][:, None] - sim <= margin


def _place(centres: dict[int, np.ndarray], threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, rows in pdf.groupby(pdf["embedding"].map(len)):
                x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
                # Scaled first, so that squares neither overflow nor vanish.
                x /= np.abs(x).max(1, keepdims=True)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                if d in centres:
                    home, visit = cells_of(unit, centres[d], threshold)
                else:
                    home, visit = np.zeros(len(x), np.int64), np.ones((len(x), 1), bool)
                row, cell = np.nonzero(visit)
                part = rows.iloc[row]
                yield pd.DataFrame({"label": part["label"].to_numpy(), "cell": cell * 100_000 + d, "rep": part["rep"].to_numpy(), "h": part["h"].to_numpy(), "copies": part["copies"].to_numpy(), "at_home": cell == home[row], "vector": [v.tobytes() for v in x[row]]})

    return run


def _none() -> pd.DataFrame:
    """Whole numbers even where empty: in floats a hash loses bits."""
    return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("rep", "h", "n", "other")})


def _multiply(threshold: float):
    """Links of the home rows of a block with all rows of another block of the cell."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["is_left"]], pdf[~pdf["is_left"]]
        none = _none()
        if not len(left) or not len(right):
            return none
        x, y = (np.frombuffer(b"".join(p["vector"]), np.float64).reshape(len(p), -1) for p in (left, right))
        x_norm, y_norm = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
        a, b, copies = left["rep"].to_numpy(), right["rep"].to_numpy(), right["copies"].to_numpy()
        a_hash, b_hash = left["h"].to_numpy(), right["h"].to_numpy()
        out = []
        for lo in range(0, len(x), 512):
            cos = (x[lo : lo + 512] @ y.T) / (x_norm[lo : lo + 512, None] * y_norm[None])
            # Products next to the threshold are summed without rounding.
            for i, j in zip(*np.nonzero(np.abs(cos - threshold) < 1e-12), strict=True):
                p, q = x[lo + i], y[j]
                cos[i, j] = math.fsum(p * q) / math.sqrt(math.fsum(p * p) * math.fsum(q * q))
            hit = (cos >= threshold) & ((a[lo : lo + 512, None] != b[None]) | (a_hash[lo : lo + 512, None] != b_hash[None]))
            n = hit @ copies
            first = np.where(hit, b[None], np.iinfo(np.int64).max).min(1)
            some = n > 0
            out.append(pd.DataFrame({"rep": a[lo : lo + 512][some], "h": a_hash[lo : lo + 512][some], "n": n[some], "other": first[some]}))
            # Links that a tree over the smallest partners misses: one for each label change.
            rows, cols = np.nonzero(hit)
            extra = b[cols] != first[rows]
            if extra.any():
                out.append(_span(a[lo : lo + 512][rows], b[cols], first[rows], extra))
        return pd.concat(out) if out else none

    return run


def _span(src: np.ndarray, dst: np.ndarray, first: np.ndarray, extra: np.ndarray) -> pd.DataFrame:
    """Of links src-dst those that join components which src-first leaves apart, with no count."""
    from .graph import label_links

    ids, low = label_links(src, first)
    at = dict(zip(ids.tolist(), low.tolist(), strict=True))
    u = np.array([at.get(v, v) for v in src[extra].tolist()])
    v = np.array([at.get(w, w) for w in dst[extra].tolist()])
    apart = u != v
    if not apart.any():
        return _none()
    ids, low = label_links(u[apart], v[apart])
    return pd.DataFrame({"rep": ids, "h": np.zeros(len(ids), np.int64), "n": np.zeros(len(ids), np.int64), "other": low})


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept, cells (of its label's vectors) for each row of embeddings(vec_id, embedding, label)."""
    spark = embeddings.sparkSession
    sc = Scratch(spark, "vectors")
    rows = doubles(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"), "embedding")
    takes_part = valid("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    distinct = rows.where(takes_part).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # A repeated vec_id may stand for several vectors; their hashes tell them apart.
    distinct = distinct.withColumn("h", F.xxhash64("label", "embedding"))
    distinct = sc.save(distinct, "distinct")
    # Cells are those of a label, so the largest label sets their number.
    n = distinct.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    some = distinct.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).toPandas()["embedding"]
    centres: dict[int, np.ndarray] = {}
    for d, part in some.groupby(some.map(len)) if len(some) else ():
        x = np.stack(part.to_numpy()).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centres[int(d)] = best_centres(x, max(1, min(MOST_CELLS, n // cell)), threshold)
    kind = dict(embeddings.dtypes)["label"]
    placed = distinct.repartition(spark.sparkContext.defaultParallelism).mapInPandas(_place(centres, threshold), f"label {kind}, cell long, rep long, h long, copies long, at_home boolean, vector binary")
    placed = sc.save(placed, "placed")
    # Blocks of a cell: those at home are dealt by hash to i, all to j; task (i, j) multiplies them.
    sizes = placed.groupBy("label", "cell").agg(F.ceil(F.count_if("at_home") / block).cast("int").alias("ni"), F.ceil(F.count("*") / block).cast("int").alias("nj"))
    sized = placed.join(sizes.where("ni > 0"), ["label", "cell"])
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    left = sized.where("at_home").select("label", "cell", place("ni").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), F.lit(True).alias("is_left"), "rep", "h", "copies", "vector")
    right = sized.select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), place("nj").alias("j"), F.lit(False).alias("is_left"), "rep", "h", "copies", "vector")
    found = sc.save(left.unionByName(right).groupBy("label", "cell", "i", "j").applyInPandas(_multiply(threshold), "rep long, h long, n long, other long"), "links")
    links = found.select(F.col("rep").alias("src"), F.col("other").alias("dst"))
    again = sc.save(rows.where(takes_part).groupBy("vec_id").count().where("count > 1").select(F.col("vec_id").alias("again")), "again")
    if not again.isEmpty():
        # Vectors of one id are one node.
        of = rows.where(takes_part).join(again, F.col("vec_id") == F.col("again"), "left_semi").join(distinct.select("label", "embedding", "rep"), ["label", "embedding"])
        links = links.unionByName(of.select(F.col("vec_id").alias("src"), F.col("rep").alias("dst")))
    label = components(sc, links)
    counts = found.groupBy("rep", "h").agg(F.sum("n").alias("n"))
    known = distinct.join(counts, ["rep", "h"], "left").join(label.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select(F.col("label").alias("k_label"), F.col("embedding").alias("k_embedding"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    got = rows.join(known, takes_part & (F.col("label") == F.col("k_label")) & (F.col("embedding") == F.col("k_embedding")), "left")
    component = F.coalesce("component_id", "vec_id")
    many = sum(len(c) for c in centres.values())
    return got.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(many).alias("cells"))
