"""URL filter: allow and block rules, and gradient-boosted trees for the urls that no rule fits.

The labelled urls are those that a rule fits (allow 1, block 0), or any table
(url, allow) that is passed. Features are lexical: lengths, depth, digit ratio,
entropy of characters, counts of parameters and marks, and the smoothed share of
allowed urls among all labelled urls with the same host suffix (last label, last two
labels and whole host, hashed into ``BUCKETS`` buckets each). Rule paths are not
features, and the share of a training row leaves the row itself out.

Bound: the trees are fitted on at most ``max_train`` labelled urls (smallest hash; copies
of a url are one, with the more frequent label, 1 if they tie); the
suffix statistics count all labelled urls. Every url is judged. Null urls, or ones
without ``://``, have an empty host and path and are judged by their (empty) features.
With fewer than two labels among the labelled urls all get the more frequent one, allow
if there are none. Urls of any length are taken whole; an empty table gives no rows.
Repeated rows and ties get equal verdicts; columns besides page_id
and url are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import ship

#: (host, path prefix, verdict). A rule is written as host followed by path prefix.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
BUCKETS = 1024
LEVELS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def suffixes(host: Column) -> Column:
    """Buckets of the host's last label, last two labels and whole."""
    keys = [F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), host]
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), k), F.lit(BUCKETS)).cast("int") for i, k in enumerate(keys)])


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    n = np.bincount(np.frombuffer(text.encode(), np.uint8))
    q = n[n > 0] / n.sum()
    return float(-(q * np.log2(q)).sum())


def features(pdf: pd.DataFrame, allowed: np.ndarray, total: np.ndarray, own: np.ndarray | None = None, copies: np.ndarray | int = 1) -> np.ndarray:
    """Rows of lexical features; allowed and total count labelled urls by level and bucket.

    own (a training row's label, or the sum over its copies) is taken out of its own counts."""
    url = pdf["url"].fillna("")
    host, path = pdf["host"], pdf["path"]
    query = url.str.partition("#")[0].str.partition("?")[2]
    size = url.str.len().to_numpy(np.float64)
    digits = url.str.count(r"[0-9]").to_numpy(np.float64)
    cols = [
        size, host.str.len(), path.str.len(), query.str.len(), path.str.count("/"), host.str.count(r"\."), digits / np.maximum(1, size),
        host.str.count(r"[0-9]"), query.str.count("=") , query.str.count("&"), url.str.count("-"), url.str.count("_"), url.str.count("%"), url.str.contains("#", regex=False).astype(float),
        url.str.startswith("https").astype(float), path.str.rpartition(".")[2].str.len().where(path.str.contains(".", regex=False), 0), url.map(_entropy), host.map(_entropy), path.str.endswith("/").astype(float),
    ]
    buckets = np.stack(pdf["suffix"].to_numpy()) if len(pdf) else np.zeros((0, LEVELS), int)
    prior = (allowed.sum() + 1) / (total.sum() + 2)
    for i in range(LEVELS):
        a, t = allowed[i, buckets[:, i]].astype(np.float64), total[i, buckets[:, i]].astype(np.float64)
        if own is not None:
            a, t = a - own, t - copies
        cols += [(a + 4 * prior) / (t + 4), np.log1p(t)]
    return np.column_stack([np.asarray(c, np.float64) for c in cols])


@dataclass
class Boosted:
    """Trees of a boosted log-odds; each node is (feature, threshold, left, right, value)."""

    start: float
    trees: list[list[tuple[int, float, int, int, float]]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            f, t, a, b, v = (np.array(c) for c in zip(*tree, strict=True))
            while (inner := a[at] >= 0).any():
                go = np.flatnonzero(inner)
                k = at[go]
                at[go] = np.where(x[go, f[k]] <= t[k], a[k], b[k])
            out += v[at]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: int = 20, shrink: float = 1.0) -> Boosted:
    """Newton boosting of the log loss with trees over quantile bins."""
    p = (y.sum() + 1) / (len(y) + 2)
    model = Boosted(float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    margin = np.full(len(y), model.start)
    for _ in range(rounds):
        score = 1 / (1 + np.exp(-margin))
        g, h = score - y, score * (1 - score)
        tree: list[tuple[int, float, int, int, float]] = []

        def grow(rows: np.ndarray, level: int, tree=tree, g=g, h=h) -> int:
            me = len(tree)
            gs, hs = g[rows].sum(), h[rows].sum()
            tree.append((0, 0.0, -1, -1, float(-rate * gs / (hs + shrink))))
            best = (1e-6, -1, -1)
            if level < depth and len(rows) >= 2 * least:
                for f, c in enumerate(cuts):
                    if len(c):
                        b = binned[rows, f]
                        gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                        nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                        gain = gl**2 / (hl + shrink) + (gs - gl) ** 2 / (hs - hl + shrink) - gs**2 / (hs + shrink)
                        gain[(nl < least) | (len(rows) - nl < least)] = -1
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), f, k)
            if best[1] >= 0:
                left = binned[rows, best[1]] <= best[2]
                a, z = grow(rows[left], level + 1), grow(rows[~left], level + 1)
                tree[me] = (best[1], float(cuts[best[1]][best[2]]), a, z, 0.0)
            else:
                margin[rows] += tree[me][4]
            return me

        grow(np.arange(len(y)), 0)
        model.trees.append(tree)
    return model


class UrlFilter:
    """A fitted filter; ``verdicts(pages)`` judges any table with page_id and url."""

    def __init__(self, labelled: DataFrame, max_train: int = 20_000):
        """labelled: url, allow (0 or 1)."""
        ship(labelled.sparkSession)
        rows = labelled.select("url", F.col("allow").cast("int").alias("allow")).where("allow is not null")
        host, path = host_and_path(F.col("url"))
        rows = rows.withColumns({"host": host, "path": path}).withColumn("suffix", suffixes(F.col("host")))
        # At most LEVELS x BUCKETS rows.
        stats = rows.select("allow", F.posexplode("suffix").alias("level", "bucket")).groupBy("level", "bucket").agg(F.sum("allow").alias("a"), F.count("*").alias("t")).toPandas()
        self.allowed, self.total = np.zeros((2, LEVELS, BUCKETS), np.int64)
        self.allowed[stats["level"], stats["bucket"]] = stats["a"]
        self.total[stats["level"], stats["bucket"]] = stats["t"]
        once = rows.groupBy("url").agg(F.sum("allow").alias("allow"), F.count("*").alias("copies")).orderBy(F.xxhash64("url"), "url").limit(max_train)
        host, path = host_and_path(F.col("url"))
        some = once.withColumns({"host": host, "path": path}).withColumn("suffix", suffixes(F.col("host"))).toPandas()
        own, copies = some["allow"].to_numpy(np.float64), some["copies"].to_numpy(np.float64)
        y = (2 * own >= copies).astype(np.float64)
        self.constant = None if len(set(y)) == 2 else float(y[0]) if len(y) else 1.0
        self.model = boost(features(some, self.allowed, self.total, own, copies), y) if self.constant is None else None

    def verdicts(self, pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
        """page_id, host, path, rule, verdict, score (of the trees)."""
        allowed, total, model, constant = self.allowed, self.total, self.model, self.constant
        host, path = host_and_path(F.col("url"))
        rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
        name, said = longest_rule(F.col("host"), F.col("path"), rules)
        rows = rows.withColumns({"rule": name, "said": said, "suffix": suffixes(F.col("host"))})

        def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                score = np.full(len(pdf), constant) if model is None else model.scores(features(pdf, allowed, total))
                out = pdf[["page_id", "host", "path", "rule"]].copy()
                out["verdict"] = pdf["said"].where(pdf["said"].notna(), np.where(score >= 0.5, "allow", "block"))
                out["score"] = score
                yield out

        kind = dict(pages.dtypes)["page_id"]
        return rows.mapInPandas(judged, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def by_rules(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, rule_verdict: what the rules say by themselves; nulls where none fits."""
    host, path = host_and_path(F.col("url"))
    name, said = longest_rule(F.col("host"), F.col("path"), rules)
    return pages.select("page_id", host.alias("host"), path.alias("path")).select("page_id", "host", "path", name.alias("rule"), said.alias("rule_verdict"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, max_train: int = 20_000) -> DataFrame:
    """Verdicts on all pages, with trees trained from the urls that a rule labels."""
    host, path = host_and_path(F.col("url"))
    said = longest_rule(host, path, rules)[1]
    labelled = pages.select("url", F.when(said == "allow", 1).when(said == "block", 0).alias("allow")).where("allow is not null")
    return UrlFilter(labelled, max_train).verdicts(pages, rules)
