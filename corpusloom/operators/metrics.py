"""Corpus BLEU and chrF++ as aggregations of clipped n-gram counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..shared import settled, ship


def tokenize_13a(x: Column) -> Column:
    """The mteval-13a tokenizer: entities, marks apart from words, commas and dots apart unless between digits."""
    steps = ((r"<skipped>", ""), (r"-\n", ""), (r"\n", " "), (r"&quot;", '"'), (r"&amp;", "&"), (r"&lt;", "<"), (r"&gt;", ">"))
    x = reduce(lambda y, s: F.regexp_replace(y, s[0], s[1]), steps, x)
    x = F.concat(F.lit(" "), x, F.lit(" "))
    apart = ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "))
    x = reduce(lambda y, s: F.regexp_replace(y, s[0], s[1]), apart, x)
    return F.filter(F.split(x, r"\s+"), lambda t: t != "")


def gram_counts(ref: np.ndarray, hyp: np.ndarray, order: int) -> list[int]:
    """Matches, hypothesis and reference n-grams of each order of two sequences of whole numbers.

    An n-gram is the (n - 1)-gram that begins it and its last item, each as its place
    among those that occur: numbers stay small and nothing is hashed."""
    items = np.unique(np.concatenate((ref, hyp)), return_inverse=True)[1]
    r, h = items[: len(ref)], items[len(ref) :]
    out, gr, gh, many = [], r, h, len(items) + 1
    for n in range(1, order + 1):
        if n > 1:
            gr, gh = gr[: max(0, len(r) - n + 1)], gh[: max(0, len(h) - n + 1)]
            gr, gh = gr * many + r[n - 1 : n - 1 + len(gr)], gh * many + h[n - 1 : n - 1 + len(gh)]
            ids = np.unique(np.concatenate((gr, gh)), return_inverse=True)[1]
            gr, gh = ids[: len(gr)], ids[len(gr) :]
        top = int(max(gr.max(initial=0), gh.max(initial=0))) + 1
        out += [int(np.minimum(np.bincount(gr, minlength=top), np.bincount(gh, minlength=top)).sum()), len(gh), len(gr)]
    return out


def ngram_statistics(pairs: DataFrame, ref: str, hyp: str, order: int, split: str = "words") -> DataFrame:
    """One row: matches, hypothesis and reference n-grams of each order up to the given one, and both lengths.

    A row's n-grams are counted where the row is, in time linear in its texts but for sorting; only a
    partition's sums are shuffled."""
    cut = {"words": lambda c: F.filter(F.split(c, r"\s+"), lambda t: t != ""), "13a": tokenize_13a, "chars": lambda c: F.regexp_replace(c, r"\s+", "")}[split]
    ship(pairs.sparkSession)
    rows = pairs.select(cut(F.coalesce(ref, F.lit(""))).alias("r"), cut(F.coalesce(hyp, F.lit(""))).alias("h"))
    names = [f"{k}{n}" for n in range(1, order + 1) for k in "mhr"]

    def numbers(r: str | list[str], h: str | list[str]) -> tuple[np.ndarray, np.ndarray]:
        if split == "chars":
            return tuple(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") for x in (r, h))
        place: dict[str, int] = {}
        return tuple(np.array([place.setdefault(w, len(place)) for w in x], np.int64) for x in (r, h))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for b in batches:
            for r, h in zip(b.column(0), b.column(1), strict=True):
                total += gram_counts(*numbers(r.as_py(), h.as_py()), order)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.tolist()], names)

    counts = rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    sums = [F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names]
    return counts.agg(*sums).withColumns({"hyp_len": F.col("h1"), "ref_len": F.col("r1")})


def bleu(pairs: DataFrame, ref: str, hyp: str, split: str = "13a") -> DataFrame:
    """One row: bleu (0 to 100), with exponential smoothing of orders without a match and the brevity penalty."""
    s = ngram_statistics(pairs, ref, hyp, 4, split)
    logs, smooth = [], F.lit(1.0)
    for n in range(1, 5):
        m, h = F.col(f"m{n}"), F.col(f"h{n}")
        smooth = F.when((m == 0) & (h > 0), smooth * 2).otherwise(smooth)
        precision = F.when(h == 0, None).when(m == 0, F.lit(100.0) / (smooth * F.greatest(h, F.lit(1)))).otherwise(m * 100.0 / F.greatest(h, F.lit(1)))
        logs.append(F.ln(precision))
    # Orders without any n-gram end the mean; nothing at all scores 0.
    some = reduce(lambda a, b: a + b, [F.when(F.col(f"h{n}") > 0, 1).otherwise(0) for n in range(1, 5)])
    mean = F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in logs]), some.cast("double"))
    penalty = F.when(F.col("hyp_len") == 0, 0.0).when(F.col("hyp_len") < F.col("ref_len"), F.exp(1 - F.try_divide(F.col("ref_len").cast("double"), F.col("hyp_len").cast("double")))).otherwise(1.0)
    matched = reduce(lambda a, b: a | b, [F.col(f"m{n}") > 0 for n in range(1, 5)])
    return s.select(F.when(~F.coalesce(matched, F.lit(False)), F.lit(0.0)).otherwise(penalty * F.exp(mean)).alias("bleu"))


def chrf(pairs: DataFrame, ref: str, hyp: str, chars: int = 6, word_order: int = 2, beta: float = 2.0) -> DataFrame:
    """One row: chrf (0 to 100): F-beta of each order of characters and words, averaged over the orders that occur on both sides."""
    named = lambda df, p, top: df.select(*[F.col(f"{k}{n}").alias(f"{p}{k}{n}") for k in "mhr" for n in range(1, top + 1)])
    both = named(ngram_statistics(pairs, ref, hyp, chars, "chars"), "c", chars)
    if word_order:
        apart = pairs.select(words_apart(ref).alias("r"), words_apart(hyp).alias("h"))
        # Two single rows side by side.
        both = both.crossJoin(named(ngram_statistics(apart, "r", "h", word_order, "words"), "w", word_order))
    scores, used = [], []
    for p, n in [("c", n) for n in range(1, chars + 1)] + [("w", n) for n in range(1, word_order + 1)]:
        m, h, r = (F.col(f"{p}{k}{n}").cast("double") for k in "mhr")
        prec, rec = F.try_divide(m, h), F.try_divide(m, r)
        occurs = (h > 0) & (r > 0)
        f = F.try_divide((1 + beta**2) * prec * rec, beta**2 * prec + rec)
        scores.append(F.when(occurs, F.coalesce(f, F.lit(0.0))).otherwise(0.0))
        used.append(F.when(occurs, 1.0).otherwise(0.0))
    total = reduce(lambda a, b: a + b, scores)
    return both.select(F.coalesce(F.try_divide(total * 100, reduce(lambda a, b: a + b, used)), F.lit(0.0)).alias("chrf"))


def words_apart(column: str) -> Column:
    """A text with the mark at a word's end (or else start) set apart from it."""
    marks = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"

    def one(t: Column) -> Column:
        return F.when(F.length(t) == 1, t).when(t.rlike(marks + "$"), F.concat(F.left(t, F.length(t) - 1), F.lit(" "), F.right(t, F.lit(1)))).when(t.rlike("^" + marks), F.concat(F.left(t, F.lit(1)), F.lit(" "), F.right(t, F.length(t) - 1))).otherwise(t)

    return F.array_join(F.transform(F.filter(F.split(F.coalesce(F.col(column), F.lit("")), r"\s+"), lambda t: t != ""), one), " ")


def greedy_match_f1(a: Column, b: Column) -> Column:
    """F1 of greedily matched vectors (arrays of equally long unit vectors), as neural match scores do."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    best = lambda u, v: F.aggregate(F.transform(u, lambda x: F.array_max(F.transform(v, lambda y: dot(x, y)))), F.lit(0.0), lambda s, z: s + z) / F.size(u)
    p, r = best(a, b), best(b, a)
    return F.try_divide(2 * p * r, p + r)


#: Numbers in the vectors of a vocabulary that every task may hold; beyond that words are joined with their vectors.
HELD_NUMBERS = 1 << 23


def _f1(units: list[np.ndarray], weights: list[np.ndarray], block: int) -> float:
    """F1 of a reference and a hypothesis: unit vectors and weights of their words, in products of blocks."""

    def best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1.0)
        for lo in range(0, len(a), block):
            for at in range(0, len(b), block):
                out[lo : lo + block] = np.maximum(out[lo : lo + block], (a[lo : lo + block] @ b[at : at + block].T).max(1))
        return out

    if not all(map(len, units)):
        return 0.0
    recall, precision = ((w * best(*u)).sum() / w.sum() if w.sum() else 0.0 for w, u in zip(weights, (units, units[::-1]), strict=True))
    return float(2 * precision * recall / (precision + recall)) if precision + recall else 0.0


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matched(block: int):
    """F1 of one pair from its distinct words (side, n, weight, vector)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row, known = pdf["row"].iloc[:1], pdf[pdf["vector"].notna()]
        sides = [known[known["side"] == s] for s in "rh"]
        f1 = 0.0
        if all(map(len, sides)):
            f1 = _f1([_unit(np.stack(s["vector"].to_numpy()).astype(np.float64)) for s in sides], [(s["n"] * s["weight"]).to_numpy(np.float64) for s in sides], block)
        return pd.DataFrame({"row": row, "f1": [f1]})

    return run


def _looked_up(vocabulary: Broadcast, block: int):
    """F1 of pairs of word arrays, whose vectors are at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, unit, weight = vocabulary.value
        for b in batches:
            found = []
            for pair in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                counts = [Counter(i for w in side if (i := place.get(w)) is not None) for side in pair]
                at = [np.fromiter(c, np.int64, len(c)) for c in counts]
                found.append(_f1([unit[i] for i in at], [weight[i] * np.fromiter(c.values(), np.float64, len(c)) for i, c in zip(at, counts, strict=True)], block))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["row", "f1"])

    return run


def match_scores(pairs: DataFrame, ref: str, hyp: str, vectors: DataFrame, idf: bool = False, block: int = 2048, held_numbers: int = HELD_NUMBERS) -> DataFrame:
    """(row, f1) of each pair: every word of a side is matched with the nearest of the other by cosine of vectors(token, vector).

    A pair's cosines are those of its distinct words, in products of blocks of their vectors. With ``idf``
    words weigh ln((N + 1) / (n + 1)), n of N references holding them. Words without a vector take
    no part; a pair with none on a side scores 0. Vectors are of one length, tokens of vectors distinct.
    A vocabulary that was counted to have at most ``held_numbers`` components is broadcast, and pairs stay where they are; else
    words are shuffled to their vectors and back to their pair."""
    spark = pairs.sparkSession
    ship(spark)
    rows = pairs.select(F.monotonically_increasing_id().alias("row"), words(F.coalesce(ref, F.lit(""))).alias("r"), words(F.coalesce(hyp, F.lit(""))).alias("h"))
    known = vectors.select("token", "vector").where("token is not null and vector is not null")
    weight = F.lit(1.0)
    if idf:
        held = pairs.select(F.explode(F.array_distinct(words(F.coalesce(ref, F.lit(""))))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
        known = known.join(held, "token", "left").crossJoin(pairs.agg(F.count("*").alias("references")))  # a single row
        weight = F.ln((F.col("references") + 1) / (F.coalesce("df", F.lit(0)) + 1))
    known = settled(known.select("token", "vector", weight.alias("weight")))
    if (known.agg(F.sum(F.size("vector"))).first()[0] or 0) <= held_numbers:
        got = known.toPandas()
        unit = _unit(np.stack(got["vector"].to_numpy()).astype(np.float64)) if len(got) else np.zeros((0, 0))
        vocabulary = spark.sparkContext.broadcast(({t: i for i, t in enumerate(got["token"])}, unit, got["weight"].to_numpy(np.float64)))
        return rows.mapInArrow(_looked_up(vocabulary, block), "row long, f1 double")
    sides = rows.select("row", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("w")) for s in "rh"])).alias("x"))
    tokens = sides.select("row", "x.side", F.explode_outer("x.w").alias("token")).groupBy("row", "side", "token").agg(F.count("*").alias("n"))
    found = tokens.join(known, "token", "left")
    return found.select("row", "side", "n", "weight", "vector").groupBy("row").applyInPandas(_matched(block), "row long, f1 double")


def all_metrics(pairs: DataFrame, ref: str, hyp: str, match: DataFrame | None = None) -> DataFrame:
    """One row, rounded to 4 decimals: bleu, chrf and bertscore, the mean of match(f1) (see match_scores); null without it."""
    mean = F.round(F.avg("f1"), 4).alias("bertscore")
    score = match.agg(mean) if match is not None else pairs.sparkSession.range(1).select(F.lit(None).cast("double").alias("bertscore"))
    # Three single rows side by side.
    both = bleu(pairs, ref, hyp).select(F.round("bleu", 4).alias("bleu")).crossJoin(chrf(pairs, ref, hyp).select(F.round("chrf", 4).alias("chrf")))
    return both.crossJoin(score)


def results_map(long: DataFrame, configs: list[str]) -> DataFrame:
    """(config, metrics) of long(config, bleu, chrf, bertscore): a null struct where a configuration has no results."""
    frame = long.sparkSession.createDataFrame([(c, i) for i, c in enumerate(configs)], "config string, place int")
    metrics = long.select("config", F.struct("bleu", "chrf", "bertscore").alias("metrics"))
    return frame.join(metrics, "config", "left").orderBy("place").select("config", "metrics")


def metrics_grid(long: DataFrame, configs: list[str], metrics: list[str], directions: list[str]) -> DataFrame:
    """(config, one column for each metric and direction) of long(config, direction, metric, value); missing values are 0."""
    cells = [F.coalesce(F.max(F.when((F.col("metric") == m) & (F.col("direction") == d), F.col("value"))), F.lit(0.0)).alias(f"{m}_{d}") for m in metrics for d in directions]
    frame = long.sparkSession.createDataFrame([(c,) for c in configs], "config string")
    return frame.join(long, "config", "left").groupBy("config").agg(*cells)
