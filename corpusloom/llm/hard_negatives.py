"""Hard-negative mining: exact windows of inner products, searched under an orthogonal PCA rotation.

Components become integers, floor(scale * c), and a score is the integer inner product.
Two searches, each of all anchors against all rows: the positives of an anchor (its best
rows of the same label), then for each positive the best rows of other labels whose score
lies between ``low`` and 100 per cent of the positive's.

The rotation R holds the eigenvectors of the second moments of all rows (one distributed
pass), largest first, so a product's leading components carry most of it. A search
accumulates the partial product of the leading components, 1/8, 1/4, 1/2 and then all of
them. What is left is at most the product of the two residual norms; with a slack for
rounding (``SLACK`` d^1.5 times the norms, far above what d additions can lose) a pair has an upper and a
lower bound. The k-th largest of the lower bounds inside a window is a floor for it; pairs
under the floor or outside of all windows are discarded before further components are
read. Survivors are verified with integer products, which alone decide.

Rows are dealt into shards once, anchors stream past them in batches (``passed``); per
shard and window the k best go on to the merge. Anchors are the stated query set (ids
divisible by ``every``); no label, vector or id gets a task of its own.

Rows with a null label or id, a null or empty vector, or a null or non-finite component, take no part;
zero vectors do. Vectors meet those of their own length; lengths other than the usual one are
searched unrotated. Rows that repeat an anchor's id are not its partners, other repeated
rows are partners each; anchors that are equal rows are one, those that share just an id each
have results. Ties go to the smaller vec_id. A positive with a score under 0 has no window.
An empty table gives no rows; extra columns are ignored. Components so large that 100
times a score could leave a long fail the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.passing import firsts, passed, vectors
from .scratch import Scratch
from .vectors import all_finite, floored, matrix, parts, summed, usual_length

SLACK = 4 * np.finfo(float).eps
#: Pairs that a task holds bounds of at once.
PAIRS = 1 << 21


def rotation(table: DataFrame, d: int) -> np.ndarray:
    """Eigenvectors (columns, largest first) of the second moments of table(x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            x = matrix(b.column(0), d).astype(np.float64)
            total += x.T @ x
        yield parts(total)

    moments = summed(table.where(F.size("x") == d).select("x").mapInArrow(run, "pos int, w array<double>"), d)
    return np.linalg.eigh(moments)[1][:, ::-1].copy()


class Rotated:
    """Vectors of one length under a rotation, with the norms of what follows each leading part."""

    def __init__(self, x: np.ndarray, turn: np.ndarray | None):
        self.x = x
        self.y = x.astype(np.float64) if turn is None else x @ turn
        d = x.shape[1]
        self.cuts = sorted({max(1, d // 8), max(1, d // 4), max(1, d // 2), d})
        squares = np.cumsum((self.y * self.y)[:, ::-1], axis=1)[:, ::-1]
        self.norm = np.sqrt(squares[:, 0])
        self.rest = [np.sqrt(squares[:, c]) if c < d else np.zeros(len(x)) for c in self.cuts]


def kth_largest(group: np.ndarray, value: np.ndarray, k: int, groups: int) -> np.ndarray:
    """The k-th largest value of each group, minus infinity where there are fewer."""
    order = np.lexsort((-value, group))
    sizes = np.bincount(group, minlength=groups)
    starts = np.cumsum(sizes) - sizes
    out = np.full(groups, -np.inf)
    full = sizes >= k
    out[full] = value[order[starts[full] + k - 1]]
    return out


def search(asked: Rotated, held: Rotated, allowed: np.ndarray | None, low: np.ndarray, high: np.ndarray, k: int, order: np.ndarray, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(asked, window, held, score) of the k best partners in each window low <= score <= high (asked x windows).

    ``allowed`` masks pairs; ``order`` ranks ties. ``seen`` gets the number of pairs that each step was left with."""
    d, (n, windows) = held.x.shape[1], low.shape
    slack = SLACK * d**1.5
    cut = held.cuts[0]
    near = asked.y[:, :cut] @ held.y[:, :cut].T
    spread = np.outer(asked.rest[0], held.rest[0]) + slack * np.outer(asked.norm, held.norm)
    alive = (near + spread >= low.min(1)[:, None]) & (near - spread <= high.max(1)[:, None])
    if allowed is not None:
        alive &= allowed
    if windows == 1 and not np.isfinite(low).any() and near.shape[1] > k:
        # Without a window the floor of each row cuts at once.
        floor = np.partition(np.where(alive, near - spread, -np.inf), near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        alive &= near + spread >= floor[:, None]
    i, j = np.nonzero(alive)
    part, off = near[i, j], spread[i, j]
    if seen is not None:
        seen.append(alive.size)
    some = max(1, PAIRS // max(1, d))
    for step in range(len(held.cuts)):
        if step:
            a, z = held.cuts[step - 1], held.cuts[step]
            if 8 * len(i) > near.size:
                # Many are left: one product of all costs less than gathering theirs.
                part = part + (asked.y[:, a:z] @ held.y[:, a:z].T)[i, j]
            else:
                part = part + np.concatenate([np.einsum("ij,ij->i", asked.y[i[s : s + some], a:z], held.y[j[s : s + some], a:z]) for s in range(0, len(i), some)] or [np.zeros(0)])
            off = asked.rest[step][i] * held.rest[step][j] + slack * asked.norm[i] * held.norm[j]
        keep = np.zeros(len(i), bool)
        least, most = part - off, part + off
        for w in range(windows):
            inside = (least >= low[i, w]) & (most <= high[i, w])
            floor = kth_largest(i[inside], least[inside], k, n)
            keep |= (most >= np.maximum(low[i, w], floor[i])) & (least <= high[i, w])
        i, j, part, off = i[keep], j[keep], part[keep], off[keep]
        if seen is not None:
            seen.append(len(i))
    score = np.concatenate([np.einsum("ij,ij->i", asked.x[i[s : s + some]], held.x[j[s : s + some]]) for s in range(0, len(i), some)] or [np.zeros(0, np.int64)])
    best = np.lexsort((order[j], -score, i))
    i, j, score = i[best], j[best], score[best]
    out = []
    for w in range(windows):
        inside = np.flatnonzero((score >= low[i, w]) & (score <= high[i, w]))
        inside = inside[firsts(i[inside], k)]
        out.append((i[inside], np.full(len(inside), w), j[inside], score[inside]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def _held(turns: dict[int, np.ndarray]):
    def run(b: pa.RecordBatch) -> dict:
        ids, labels = _column(b, "vec_id").to_numpy(), _column(b, "label").to_numpy()
        found = {}
        for d, at, x in vectors(_column(b, "x")):
            # By label, so that rows of one lie together.
            turn = np.lexsort((ids[at], labels[at]))
            found[d] = ids[at][turn], labels[at][turn], Rotated(x[turn], turns.get(d))
        return found

    return run


def _part(r: Rotated, at: np.ndarray | slice) -> Rotated:
    out = object.__new__(Rotated)
    out.x, out.y, out.cuts, out.norm, out.rest = r.x[at], r.y[at], r.cuts, r.norm[at], [q[at] for q in r.rest]
    return out


def _positives(turns: dict[int, np.ndarray], k: int):
    """Per shard the k best rows of an anchor's label."""

    def run(shard: dict, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        no, ids, labels = (_column(b, c).to_numpy() for c in ("anchor", "vec_id", "label"))
        for d, places, x in vectors(_column(b, "x")):
            if d not in shard:
                continue
            held_ids, held_labels, held = shard[d]
            asked = Rotated(x, turns.get(d))
            for label in np.unique(labels[places]):
                a, z = np.searchsorted(held_labels, [label, label + 1])
                mine = np.flatnonzero(labels[places] == label)
                if a == z:
                    continue
                rows, own = _part(held, slice(a, z)), held_ids[a:z]
                step = max(1, PAIRS // (z - a))
                for lo in range(0, len(mine), step):
                    some = mine[lo : lo + step]
                    every = np.full((len(some), 1), np.inf)
                    i, _, j, score = search(_part(asked, some), rows, own[None] != ids[places[some]][:, None], -every, every, k, own)
                    yield pa.RecordBatch.from_arrays([pa.array(no[places[some[i]]]), pa.array(own[j]), pa.array(score)], ["anchor", "vec_id", "score"])

    return run


def _negatives(turns: dict[int, np.ndarray], k: int, percent: int):
    """Per shard and positive the k best rows of other labels in its window."""

    def run(shard: dict, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        no, ids, labels = (_column(b, c).to_numpy() for c in ("anchor", "vec_id", "label"))
        sizes = _column(b, "scores").value_lengths().to_numpy()
        scores = np.full((len(b), max(1, sizes.max(initial=0))), -1, np.int64)
        scores[np.arange(scores.shape[1]) < sizes[:, None]] = _column(b, "scores").flatten().to_numpy()
        # An empty window for those under 0: no score is at least 1 and at most 0.
        low = np.where(scores < 0, 1, -(-percent * scores // 100))
        high = np.where(scores < 0, 0, scores)
        for d, places, x in vectors(_column(b, "x")):
            if d not in shard:
                continue
            held_ids, held_labels, held = shard[d]
            asked = Rotated(x, turns.get(d))
            step = max(1, PAIRS // len(held_ids))
            for lo in range(0, len(places), step):
                at = places[lo : lo + step]
                other = (held_labels[None] != labels[at][:, None]) & (held_ids[None] != ids[at][:, None])
                i, w, j, score = search(_part(asked, slice(lo, lo + step)), held, other, low[at], high[at], k, held_ids)
                yield pa.RecordBatch.from_arrays([pa.array(no[at[i]]), pa.array(w.astype(np.int32)), pa.array(held_ids[j]), pa.array(score)], ["anchor", "place", "vec_id", "score"])

    return run


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, shard: int = 50_000) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows(vec_id long, label long, x array<long>)."""
    sc = Scratch(rows.sparkSession, "negatives")
    # The number tells repeated rows apart, for dealing.
    table = sc.save(rows.withColumn("no", F.monotonically_increasing_id()), "rows")
    d = usual_length(table, "x")
    widest, far = table.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    if 100 * (widest or 0) * (far or 0) ** 2 >= 1 << 63:
        raise OverflowError("scores of these vectors leave a long")
    turns = {d: rotation(table, d)} if d else {}
    held = table.select("vec_id", "label", "x", "no")
    anchors = table.where(F.col("vec_id") % every == 0).select("vec_id", "label", "x").distinct()
    anchors = sc.save(anchors.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    found = passed(held, anchors, held["no"], _held(turns), _positives(turns, positives), "anchor long, vec_id long, score long", shard)
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(best("anchor"))).where(F.col("r") <= positives)
    lists = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("p"))
    # The positives of an anchor are at most so many.
    asked = sc.save(anchors.join(lists, "anchor").withColumn("scores", F.transform("p", lambda q: q["score"])), "positives")
    hard = passed(held, asked.drop("p"), held["no"], _held(turns), _negatives(turns, negatives, low), "anchor long, place int, vec_id long, score long", shard)
    hard = hard.withColumn("rank", F.row_number().over(best("anchor", "place"))).where(F.col("rank") <= negatives)
    of = asked.select("anchor", F.col("vec_id").alias("anchor_id"), "p")
    positive = F.col("p")[F.col("place")]
    return hard.join(of, "anchor").select("anchor_id", positive["vec_id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def hard_negatives(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """Mined from embeddings(vec_id, embedding, label), labels of ids divisible by 7 moved on by one of ten."""
    label = F.col("label").cast("long")
    rows = embeddings.where(all_finite("embedding") & (F.size("embedding") > 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(rows.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), floored("embedding", scale, 1 << 40).alias("x")))
