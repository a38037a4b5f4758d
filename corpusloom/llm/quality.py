"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of 32 words. Each passage is encoded by the square
roots of its frequencies of byte-class pairs (letters by case, digits, white space,
each common mark, bytes beyond ASCII) and a few word statistics; a learned layer embeds
it. Gated attention (tanh times sigmoid) weighs the passages of a document, and the
weighted sum is scored by a logistic unit. Only document labels train it.

Bound: the model is fitted on at most ``max_train`` labelled documents (the ones with
the smallest hash of doc_id, each once: with the more frequent of its labels, the larger
one of a tie, and of its rows the text with the smallest hash), each over its whole text;
the driver holds the non-zero features of their passages, about 50 bytes each. Every
document of the table is scored over its whole text, a passage at a time.

Nulls and texts without words are a bag of one passage without counts. Null ids train
nothing and are scored. Texts of any length are taken whole. Ties and repeated rows get
equal scores. With labels of one class or none, all scores are 0.5; an empty table gives
no rows. Columns other than the id and the text are ignored; those of ``keep_good`` keep
their values, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch as S
from .textbytes import blocks, word_hashes, word_spans

PASSAGE_WORDS = 32
#: Bytes of the same class count alike; all others are one class more.
CLASSES = (bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" \t\n\v\f\r", bytes(range(128, 256)), b".,", b"!?", b"|", b"%", b"&", b"*", b"#$", b"<>", b"-_'\"", b"/:;()=+@")
N_CLASS = len(CLASSES) + 1
_CLASS = np.full(256, N_CLASS - 1, np.uint8)
for _k, _bytes in enumerate(CLASSES):
    _CLASS[list(_bytes)] = _k
_NL = 10
N_FEATURES = N_CLASS * N_CLASS + 7


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, number of passages of each row)."""
    n = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets)
    first = np.searchsorted(rows, np.arange(n + 1))
    words = np.diff(first)
    count = np.maximum(1, -(-words // PASSAGE_WORDS))
    base = np.concatenate(([0], np.cumsum(count)))
    total = int(base[-1])
    out = np.zeros((total, N_FEATURES), np.float32)
    if not len(starts):
        return out, count
    in_row = np.arange(len(starts)) - first[rows]
    passage = base[rows] + in_row // PASSAGE_WORDS
    # A byte belongs to the passage of the last word that began before it.
    reach = np.diff(np.concatenate((starts, [len(data)])))
    lead = int(starts[0])
    of_byte = np.repeat(passage, reach)
    classes = _CLASS[data[lead:]].astype(np.int64)
    pair = of_byte[:-1] * (N_CLASS * N_CLASS) + classes[:-1] * N_CLASS + classes[1:]
    same = of_byte[:-1] == of_byte[1:]
    seen = np.bincount(pair[same], minlength=total * N_CLASS * N_CLASS).reshape(total, -1)
    out[:, : N_CLASS * N_CLASS] = np.sqrt(seen / np.maximum(1, seen.sum(1, keepdims=True)))
    length = (ends - starts).astype(np.float64)
    per = np.maximum(1, np.bincount(passage, minlength=total))
    mean = np.bincount(passage, length, minlength=total) / per
    spread = np.sqrt(np.maximum(0, np.bincount(passage, length**2, minlength=total) / per - mean**2))
    upper = np.bincount(passage, _CLASS[data[starts]] == 1, minlength=total) / per
    lines = np.bincount(of_byte, data[lead:] == _NL, minlength=total) / per
    h = word_hashes(data, starts, ends)
    again = np.concatenate(([False], (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])))
    repeated = np.bincount(passage, again, minlength=total) / per
    out[:, -7:] = np.stack((mean / 10, spread / 10, upper, lines, repeated, per / PASSAGE_WORDS, np.ones(total)), 1)
    return out, count


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Model:
    """Weights of the embedding (w), the attention (v, u, a) and the document score (c, c0)."""

    w: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    c0: float

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        h = np.tanh(x @ self.w)
        t, g = np.tanh(h @ self.v), _sigmoid(h @ self.u)
        e = (t * g) @ self.a
        at = np.concatenate(([0], np.cumsum(count)[:-1]))
        bag = np.repeat(np.arange(len(count)), count)
        e = np.exp(e - np.maximum.reduceat(e, at)[bag])
        weight = e / np.add.reduceat(e, at)[bag]
        z = np.add.reduceat(weight[:, None] * h, at, axis=0)
        return {"h": h, "t": t, "g": g, "weight": weight, "bag": bag, "at": at, "z": z, "score": _sigmoid(z @ self.c + self.c0)}

    def scores(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.forward(x, count)["score"] if len(count) else np.zeros(0)


_REST = N_FEATURES - N_CLASS * N_CLASS


def packed(x: np.ndarray) -> bytes:
    """A bag's features without their zeros: number of passages, pairs of each, their places and values, other features."""
    pairs = x[:, :-_REST]
    row, place = np.nonzero(pairs)
    count = np.bincount(row, minlength=len(x)).astype("<u2")
    return np.array([len(x)], "<u4").tobytes() + count.tobytes() + place.astype("<u2").tobytes() + pairs[row, place].astype("<f2").tobytes() + x[:, -_REST:].astype("<f2").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    count = np.frombuffer(raw, "<u2", n, 4).astype(np.int64)
    m, at = int(count.sum()), 4 + 2 * n
    out = np.zeros((n, N_FEATURES), np.float32)
    out[np.repeat(np.arange(n), count), np.frombuffer(raw, "<u2", m, at)] = np.frombuffer(raw, "<f2", m, at + 2 * m)
    out[:, -_REST:] = np.frombuffer(raw, "<f2", n * _REST, at + 4 * m).reshape(n, _REST)
    return out


def gradients(p: dict[str, np.ndarray], xs: np.ndarray, cs: np.ndarray, ys: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss of the bags (xs, cs passages each) with labels ys, by the parameters; through the attention weights."""
    s = Model(p["w"], p["v"], p["u"], p["a"], p["c"], float(p["c0"][0])).forward(xs, cs)
    d = ((s["score"] - ys) / len(ys)).astype(p["w"].dtype)
    grad = {"c": s["z"].T @ d, "c0": np.array([d.sum()])}
    dz = (d[:, None] * p["c"])[s["bag"]]
    dw = (dz * s["h"]).sum(1)
    de = s["weight"] * (dw - np.add.reduceat(s["weight"] * dw, s["at"])[s["bag"]])
    tg = s["t"] * s["g"]
    grad["a"] = tg.T @ de
    dtg = de[:, None] * p["a"]
    dt, dg = dtg * s["g"] * (1 - s["t"] ** 2), dtg * s["t"] * s["g"] * (1 - s["g"])
    grad["v"], grad["u"] = s["h"].T @ dt, s["h"].T @ dg
    dh = s["weight"][:, None] * dz + dt @ p["v"].T + dg @ p["u"].T
    grad["w"] = xs.T @ (dh * (1 - s["h"] ** 2))
    return grad


def train(bags: list[np.ndarray] | list[bytes], y: np.ndarray, width: int = 24, epochs: int = 40, batch: int = 48, rate: float = 0.004, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the log loss of documents; bags are features of passages, or ``packed`` ones that are unpacked for each step."""
    rng = np.random.default_rng(seed)
    full = lambda x: unpacked(x) if isinstance(x, bytes) else x
    f = full(bags[0]).shape[1]
    p = {"w": rng.normal(0, 1.5 / np.sqrt(24), (f, width)), "v": rng.normal(0, 0.3, (width, width)), "u": rng.normal(0, 0.3, (width, width)), "a": rng.normal(0, 0.3, width), "c": rng.normal(0, 0.3, width), "c0": np.zeros(1)}
    p = {k: q.astype(np.float32) for k, q in p.items()}
    m1 = {k: np.zeros_like(q) for k, q in p.items()}
    m2 = {k: np.zeros_like(q) for k, q in p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            pick = order[lo : lo + batch]
            some = [full(bags[i]) for i in pick]
            xs, cs, ys = np.concatenate(some).astype(np.float32), np.array([len(x) for x in some]), y[pick]
            grad = gradients(p, xs, cs, ys)
            step += 1
            r = rate * (1 if epoch < epochs * 0.7 else 0.2)
            for k, g in grad.items():
                g = g.astype(np.float32) + (decay * p[k] if k != "c0" else 0)
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] -= r * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Model(p["w"], p["v"], p["u"], p["a"], p["c"], float(p["c0"][0]))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Documents whose labels train nothing: crc32 of the id as text, divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        label = b.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in blocks(b.column(0)):
            x, count = encode(data, offsets)
            at = np.concatenate(([0], np.cumsum(count)))
            some = [packed(x[at[i] : at[i + 1]]) for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array(label[lo:hi].astype(np.float64))], ["x", "y"])


def fit(documents: DataFrame, labels: DataFrame, max_train: int = 3000, target: str = "quality") -> Model | None:
    """The model, or None if the labels hold fewer than two classes."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(target).cast("double").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out("id"))
    # Copies of a label combine before the shuffle; one row is left of each id.
    once = known.groupBy("id", "y").count().groupBy("id").agg(F.max(F.struct("count", "y")).alias("m")).select("id", "m.y")
    # A stated bound: at most max_train ids, so the list may be broadcast.
    some = once.orderBy(F.xxhash64("id"), "id").limit(max_train)
    texts = documents.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("id"))
    texts = texts.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m")).select(F.col("m.text").alias("text"), "y", "id")
    bags = texts.repartition(S.partitions(documents.sparkSession), "id").select("text", "y").mapInArrow(_encoded, "x binary, y double")
    rows = sorted((bytes(r.x), r.y) for r in bags.toLocalIterator())
    y = np.array([r[1] for r in rows])
    if len(set(y)) < 2:
        return None
    return train([r[0] for r in rows], y)


def score(documents: DataFrame, model: Model | None, prior: float = 0.5, out: str = "quality_score") -> DataFrame:
    """documents with a column ``out`` (replacing one of that name); prior is the score without a model."""
    kept = documents.drop(out)
    place = kept.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.full(b.num_rows, prior)
            if model is not None:
                for lo, hi, data, offsets in blocks(b.column(place)):
                    got[lo:hi] = model.scores(*encode(data, offsets))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], [*b.schema.names, out])

    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())])
    S.ship(documents.sparkSession)
    return kept.mapInArrow(scored, schema)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    S.ship(documents.sparkSession)
    model = fit(documents, labels, max_train)
    got = score(documents.select("doc_id", "text"), model)
    return got.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train: int = 3000) -> DataFrame:
    """The rows of documents that the classifier doesn't reject, columns unchanged."""
    S.ship(documents.sparkSession)
    own = "quality_score"
    while own in documents.columns:
        own = f"_{own}"
    got = score(documents, fit(documents, labels, max_train), out=own)
    return got.where(F.col(own) >= threshold).select(*documents.columns)
