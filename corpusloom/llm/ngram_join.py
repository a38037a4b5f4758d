"""N-gram Jaccard join by T-occurrence search.

Texts are compared by their sets of distinct n-word shingles (64-bit hashes over
words with A-Z lower-cased). Two documents link when 100 * |x & y| >= percent * |x | y|.

1. Documents with equal sets form a class; its smallest doc_id stands for it.
2. A shingle order puts shingles that are frequent in a bounded sample last. The order
   only steers cost: any order that all documents share gives the same links. Linked
   sets share one of the first n - ceil(t n) + 1 shingles (prefix filter), so classes
   meet in the lists of those shingles.
3. Each list first links its members to one of them (a star), so a list of m near
   copies costs m searches, not m * m / 2. Lists that still hold many pairs across
   components are searched as groups, where a member is done with a component as soon
   as one link reaches it. All pairs across components that then remain in any list
   are searched, none skipped.
4. Pairs are grouped by their query class and searched by DivideSkip: short inverted
   lists are heap-merged, long ones are probed by binary search, and documents that
   reach the required overlap are kept. It runs on the first shingles of the order
   with the overlap that is needed there, then on whole sets, which decides exactly.

Null or empty texts and texts without words have an empty set and link with nothing;
fewer words than n make one shingle of the whole sequence. Rows with a null doc_id get
their set size and a null component. Rows that repeat a doc_id are one node of the
graph, each of their sets searched. Texts of any length are taken whole; an empty table
gives no rows. Extra columns are ignored, and kept unchanged by ``keep_one``. Groups of a
query are salted by ``SALT`` members.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, deal
from .scratch import Scratch
from .textbytes import mix, shingle_sets

#: Members of a query that one search handles.
SALT = 1000
#: Frequent shingles that the order knows (16 MB).
HEAVY = 1_000_000
#: Ids up to which the list of documents to be read again is broadcast (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members in a block of a crowded list; a task searches two blocks.
TOGETHER = 800
#: Times that crowded lists are searched as groups.
TURNS = 2
_U = np.uint64


def required(x: int | np.ndarray, y: int | np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of linked sets of these sizes: 100 o >= percent (x + y - o)."""
    return -(-percent * (x + y) // (100 + percent))


def divide_skip(query: np.ndarray, members: list[np.ndarray], need: np.ndarray, mu: float = 0.01) -> np.ndarray:
    """Overlap of each sorted member with the sorted query; exact where it is at least need, else 0.

    need is at least 1. The longest lists (of the query's elements, over the members)
    are set aside; the others are merged through a heap, and members that appear often
    enough in those are probed in the long lists.
    """
    out = np.zeros(len(members), np.int64)
    if not len(members) or not len(query):
        return out
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    flat = np.concatenate(members)
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    hit = query[at] == flat
    at, owner = at[hit], owner[hit]
    length = np.bincount(at, minlength=len(query))
    owner = owner[np.argsort(at, kind="stable")]
    end = np.cumsum(length)
    least = int(need.min())
    order = np.argsort(length, kind="stable")
    order = order[length[order] > 0]
    if not len(order):
        return out
    n_long = min(int(least / (mu * np.log2(max(2, int(length.max()))) + 1)), least - 1, len(order))
    lists = [owner[end[i] - length[i] : end[i]] for i in order]
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    enough = least - n_long
    found: list[int] = []
    counts: list[int] = []
    if len(members) == 1:
        found, counts = [0], [len(short)]
    else:
        for member, run in groupby(heapq.merge(*[x.tolist() for x in short])):
            if (k := sum(1 for _ in run)) >= enough:
                found.append(member)
                counts.append(k)
    if not found:
        return out
    ids, total = np.array(found), np.array(counts)
    for x in long:
        k = np.minimum(np.searchsorted(x, ids), len(x) - 1)
        total += x[k] == ids
    good = total >= need[ids]
    out[ids[good]] = total[good]
    return out


def _split(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def _sets(n: int, percent: int, heavy: np.ndarray, rank: np.ndarray):
    """doc_id, size, 128-bit digest, length of the prefix, first shingles in the shared order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, d1, d2, prefix, blob = [], [], [], [], []
            for s in shingle_sets(b.column(1), n):
                k = len(s)
                size.append(k)
                d1.append(int(mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                d2.append(int(mix(s + _U(0x14057B7EF767814F)).sum(dtype=np.uint64).astype(np.int64)))
                p = k - -(-percent * k // 100) + 1 if k else 0
                prefix.append(p)
                if k and len(heavy):
                    i = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                    common = heavy[i] == s
                    late = s[common]
                    s = np.concatenate((s[~common], late[np.argsort(rank[i[common]], kind="stable")]))
                blob.append(s[:p].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(prefix, pa.int32()), pa.array(blob, pa.binary())], ["doc_id", "n", "d1", "d2", "p", "first"])

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rep, n, p = (b.column(i).to_numpy() for i in range(3))
        for lo in range(0, len(rep), 256):
            part = slice(lo, lo + 256)
            tokens = [_split(x)[:k] for x, k in zip(b.column(3)[part].to_pylist(), p[part], strict=True)]
            if tokens:
                rest = np.concatenate([np.arange(m, m - len(t), -1) for m, t in zip(n[part], tokens, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(rep[part], p[part])), pa.array(np.repeat(n[part], p[part])), pa.array(rest)], ["token", "rep", "n", "rest"])


def _shared(percent: int):
    """Of postings sorted by (token, n, rep): those of tokens with several, each with its hub.

    The hub is the first member, renewed where its set is too small for a link. State
    is one posting, so lists of any length stream through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # a posting (token, rep, n, rest), its hub's (rep, n, rest), whether it is written
        for b in batches:
            token, rep, n, rest = (b.column(i).to_numpy() for i in range(4))
            if not len(token):
                continue
            if last is not None:
                token, rep, n, rest = (np.concatenate(([v], a)) for v, a in zip(last[0], (token, rep, n, rest), strict=True))
            new = np.concatenate(([True], token[1:] != token[:-1]))
            single = new & np.concatenate((new[1:], [False]))
            lead = np.arange(len(token))
            hub, hub_n, hub_rest = rep.copy(), n.copy(), rest.copy()
            if last is not None:
                hub[0], hub_n[0], hub_rest[0] = last[1]
            for i in np.flatnonzero(~new):
                if hub_n[lead[i - 1]] * 100 >= percent * n[i]:
                    lead[i] = lead[i - 1]
            hub, hub_n, hub_rest = hub[lead], hub_n[lead], hub_rest[lead]
            k = len(token) - 1
            write = ~single
            if last is not None and last[2]:
                write[0] = False
            if new[k]:
                write[k] = False
            if write.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[write]) for x in (token, rep, n, rest, hub, hub_n, hub_rest)], ["token", "rep", "n", "rest", "hub", "hub_n", "hub_rest"])
            done = bool(write[k]) or (k == 0 and last is not None and last[2])
            last = (token[k], rep[k], n[k], rest[k]), (hub[k], hub_n[k], hub_rest[k]), done

    return run


def _may_link(i: int, low: np.ndarray, n: np.ndarray, rest: np.ndarray, comp: np.ndarray, homes: np.ndarray, percent: int) -> np.ndarray:
    """Earlier members of a list (sorted by n) that member i may link with and that aren't known to be settled.

    The sizes must allow it, and so must what is left of both sets from this shingle on
    (rest): if it is the first that they share, they share no more than that. Members
    of one component, or searched together before (equal homes but 0), are settled."""
    j = np.arange(low[i], i)
    good = (comp[j] != comp[i]) & (np.minimum(rest[j], rest[i]) >= required(n[i], n[j], percent))
    for h in homes:
        good &= (h[j] != h[i]) | (h[i] == 0)
    return j[good]


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of equal first values."""
    rest = [np.zeros(0, np.int64)] * width
    for b in batches:
        cols = [np.concatenate((r, b.column(i).to_numpy())) for i, r in enumerate(rest)]
        cuts = np.concatenate(([0], np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1)) if len(cols[0]) else np.zeros(1, np.int64)
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            yield [c[a:z] for c in cols]
        rest = [c[cuts[-1] :] for c in cols]
    if len(rest[0]):
        yield rest


def _across(percent: int, only_count: bool, most: int = 1 << 16):
    """Of postings (token, n, rep, rest, comp, homes...) sorted so: pairs that may link, or (token, members, pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, held, tally = [], [], 0, []

        def made() -> pa.RecordBatch:
            a, z = np.concatenate(x), np.concatenate(y)
            both = np.unique(np.stack((np.minimum(a, z), np.maximum(a, z))), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["hub", "member"])

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*tally, strict=True)], ["token", "m", "pairs"])

        for token, n, rep, rest, comp, *homes in _runs(batches, 5 + TURNS):
            low = np.searchsorted(n * 100, percent * n, "left")
            pairs = 0
            for i in range(1, len(rep)):
                j = _may_link(i, low, n, rest, comp, homes, percent)
                pairs += len(j)
                if len(j) and not only_count:
                    x.append(rep[j])
                    y.append(np.full(len(j), rep[i]))
                    held += len(j)
                    if held >= most:
                        yield made()
                        x, y, held = [], [], 0
            if only_count and pairs:
                tally.append((int(token[0]), len(rep), pairs))
                if len(tally) >= most:
                    yield told()
                    tally = []
        if held:
            yield made()
        if tally:
            yield told()

    return run


def _settle(percent: int):
    """Of rows (token, x, y, n, rep, side, comp, home, blob), sorted so: links that connect the members of each group as far as any do.

    A group holds blocks x and y of a list; if they differ, only pairs across them are
    searched here. Each member is searched among earlier ones of other components, a few
    at first and then more, and leaves out those that a link has meanwhile connected
    with it, and those it has been searched with before (equal homes but 0)."""

    def one(group: list[tuple]) -> list[tuple[int, int]]:
        n, rep, side, label, home = (np.array([r[k] for r in group]) for k in range(3, 8))
        sets = [_split(r[8]) for r in group]
        across = group[0][1] != group[0][2]
        low = np.searchsorted(n * 100, percent * n, "left")
        found = []
        for i in range(1, len(group)):
            j = np.arange(i - 1, low[i] - 1, -1)
            todo, chunk = j[((home[j] != home[i]) | (home[i] == 0)) & ((side[j] != side[i]) | (not across))], 4
            while len(todo := todo[label[todo] != label[i]]):
                some, todo, chunk = todo[:chunk], todo[chunk:], chunk * 4
                got = divide_skip(sets[i], [sets[k] for k in some], required(n[i], n[some], percent))
                for k in some[got > 0]:
                    if label[k] != label[i]:
                        label[label == label[i]] = label[k]
                        found.append((rep[i], rep[k]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

        def told() -> Iterator[pa.RecordBatch]:
            if len(group) > 1 and (found := one(group)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema)

        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(9)], strict=True):
                if group and group[0][:3] != row[:3]:
                    yield from told()
                    group = []
                group.append(row)
        yield from told()

    return run


def _search(percent: int, whole: bool):
    """Of rows (hub, salt, own, member, n, blob), sorted so that a query's own row leads its group: linked members."""

    def one(group: list[tuple]) -> list[tuple[int, int]]:
        rest = [r for r in group if not r[2]]
        if not rest:
            return []
        sizes = np.array([r[4] for r in rest])
        sets = [np.sort(_split(r[5])) for r in rest]
        beyond = sizes - np.array([len(s) for s in sets])
        found = []
        for own in group[: len(group) - len(rest)]:
            query = np.sort(_split(own[5]))
            need = required(own[4], sizes, percent)
            if not whole:  # shingles beyond the first ones may all be shared
                need = need - np.maximum(own[4] - len(query), beyond)
            found += [(own[0], rest[i][3]) for i in np.flatnonzero(divide_skip(query, sets, np.maximum(1, need)))]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for b in batches:
            found: list[tuple[int, int]] = []
            hub, salt, own, member, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            blob = b.column(5)
            for i in range(b.num_rows):
                if group and (group[0][0] != hub[i] or group[0][1] != salt[i]):
                    found += one(group)
                    group = []
                group.append((hub[i], salt[i], own[i], member[i], int(n[i]), blob[i].as_py()))
            if found:
                yield pa.RecordBatch.from_pylist([{"src": int(a), "dst": int(z)} for a, z in found], pa.schema([("src", pa.int64()), ("dst", pa.int64())]))
        if group and (found := one(group)):
            yield pa.RecordBatch.from_pylist([{"src": int(a), "dst": int(z)} for a, z in found], pa.schema([("src", pa.int64()), ("dst", pa.int64())]))

    return run


class NgramJoin:
    """One join; ``rows()`` gives a row for each document, ``links`` the verified links between classes."""

    def __init__(self, documents: DataFrame, n: int = 5, percent: int = 80, sample_docs: tuple[int, int] = (16_000, 500_000), tag: str = "ngram"):
        spark = documents.sparkSession
        self.n, self.percent = n, percent
        self.scratch = Scratch(spark, tag)
        self.documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        heavy, rank = self._frequent(sample_docs)
        sets = self.documents.mapInArrow(_sets(n, percent, heavy, rank), "doc_id long, n long, d1 long, d2 long, p int, first binary")
        full = self.scratch.save(sets, "sets")
        self.sets = self.scratch.save(full.select("doc_id", "n", "d1", "d2"), "sizes")
        classes = full.where("doc_id is not null and n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("p", "first"), "doc_id").alias("x"))
        self.reps = self.scratch.save(classes.select("n", "d1", "d2", "rep", "x.*"), "classes")
        self.classes = self.reps.select("n", "d1", "d2", "rep")
        self.scratch.drop(full)
        self.scratch.release()
        self.links = self._link()
        self.components = components(self.scratch, self.links)

    def _frequent(self, sample_docs: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Shingles found at least 3 times in a sample, sorted, with their places in the order; ``HEAVY`` at most.

        The sample is a quarter of the documents, by a hash of the id, between the two
        bounds. Only the quarter of each set with the smallest hashes counts, where
        prefixes lie."""
        total = max(1, self.documents.count())
        share = min(1.0, min(sample_docs[1], max(sample_docs[0], total / 4)) / total)
        n = self.n

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                all_ = [s[: 2 + len(s) // 4] for s in shingle_sets(b.column(0), n) if len(s)]
                if all_:
                    h, c = np.unique(np.concatenate(all_), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        some = self.documents.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)))
        rows = some.select("text").mapInArrow(counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c >= 3").orderBy(F.desc("c"), "h").limit(HEAVY).toPandas()
        h = rows["h"].to_numpy(np.int64).view(np.uint64)
        c = rows["c"].to_numpy(np.int64)
        by = np.argsort(h)
        h, c = h[by], c[by]
        rank = np.empty(len(h), np.int64)
        rank[np.lexsort((h, c))] = np.arange(len(h))
        return h, rank

    def _link(self) -> DataFrame:
        sc, percent = self.scratch, self.percent
        posted = self.reps.select("rep", "n", "p", "first").mapInArrow(_postings, "token long, rep long, n long, rest long")
        lists = sc.save(deal(posted, "token").sortWithinPartitions("token", "n", "rep").mapInArrow(_shared(percent), "token long, rep long, n long, rest long, hub long, hub_n long, hub_rest long"), "lists")
        sc.release()
        able = F.least("rest", "hub_rest") * (100 + percent) >= percent * (F.col("n") + F.col("hub_n"))
        tried = sc.save(lists.where("hub <> rep").where(able).select(F.least("hub", "rep").alias("hub"), F.greatest("hub", "rep").alias("member")).distinct(), "pairs")
        links = self._verify(tried)
        homes: list[DataFrame | None] = [None] * TURNS
        for turn in range(TURNS):
            left = self._named(lists, links, homes)
            counts = sc.save(self._sorted(left).mapInArrow(_across(percent, True), "token long, m long, pairs long"), "crowds")
            # A list without pairs now has none later: components only grow.
            lists = lists.join(self._small(counts.select("token")), "token", "left_semi")
            more, homes[turn] = self._together(left, counts.where("pairs > m"))
            links = sc.save(links.unionByName(more), "links")
            sc.release()
        pairs = self._sorted(self._named(lists, links, homes)).mapInArrow(_across(percent, False), "hub long, member long")
        more = sc.save(pairs.distinct().join(tried, ["hub", "member"], "left_anti"), "across")
        return sc.save(links.unionByName(self._verify(more)), "links")

    def _sorted(self, left: DataFrame) -> DataFrame:
        return deal(left, "token").sortWithinPartitions("token", "n", "rep").select("token", "n", "rep", "rest", "comp", *(f"home{k}" for k in range(TURNS)))

    def _small(self, df: DataFrame) -> DataFrame:
        """df, to be broadcast if it has been counted to be short (40 MB at most); else a shuffle joins it."""
        return F.broadcast(df) if df.count() <= BROADCAST_IDS else df

    def _named(self, lists: DataFrame, links: DataFrame, homes: list[DataFrame | None]) -> DataFrame:
        """The postings with the component and the homes of each class."""
        label = components(self.scratch, links).withColumnRenamed("id", "rep")
        named = lists.join(self._small(label), "rep", "left").select("token", "n", "rep", "rest", F.coalesce("component", "rep").alias("comp"))
        for k, home in enumerate(homes):
            named = named.join(self._small(home.withColumnRenamed("home", f"home{k}")), "rep", "left") if home is not None else named.withColumn(f"home{k}", F.lit(0).cast("long"))
        return named.fillna(0, [f"home{k}" for k in range(TURNS)])

    def _together(self, left: DataFrame, crowds: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Searches crowded lists by whole sets: links, and (rep, home), home being the list that a class was searched in.

        Each class joins only the list that has most pairs, so near copies meet in one.
        Lists are cut into blocks of about ``TOGETHER`` members; a task has two blocks."""
        sc = self.scratch
        homes = [F.col(f"home{k}") for k in range(TURNS)]
        # The latest home: two members of it have been searched together.
        mine = left.select("token", "rep", "n", "comp", F.coalesce(*(F.when(h != 0, h) for h in reversed(homes)), F.lit(0)).alias("home")).join(self._small(crowds), "token")
        mine = mine.groupBy("rep", "n", "comp", "home").agg(F.max(F.struct("pairs", "m", "token")).alias("l"))
        mine = sc.save(mine.select("rep", "n", "comp", "home", "l.token", F.ceil(F.col("l.m") / TOGETHER).cast("int").alias("cut")), "together")
        full = self._whole(mine.select(F.col("rep").alias("doc_id")).distinct())
        side = F.pmod(F.xxhash64("rep"), F.col("cut")).cast("int")
        placed = mine.select("*", side.alias("side"), F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("other"))
        rows = full.join(self._small(placed), ["rep", "n"]).select("token", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "n", "rep", "side", "comp", "home", "blob")
        links = deal(rows, "token", "x", "y").sortWithinPartitions("token", "x", "y", "n", "rep").mapInArrow(_settle(self.percent), "src long, dst long")
        links = sc.save(links, "settled")
        sc.drop(full)
        return links, sc.save(mine.groupBy("rep").agg(F.min("token").alias("home")), "homes")

    def _whole(self, ids: DataFrame) -> DataFrame:
        """rep, n and the whole sorted set of the documents with these ids, from their texts."""
        ids = self.scratch.save(ids, "ids")
        few = ids.count() <= BROADCAST_IDS
        texts = self.documents.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
        n = self.n

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = list(shingle_sets(b.column(1), n))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], ["rep", "n", "blob"])

        return self.scratch.save(texts.mapInArrow(whole, "rep long, n long, blob binary"), "whole")

    def _attach(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Rows of sets(rep, n, blob) for the members of each query, and for the query itself once a salt."""
        per = self.scratch.save(pairs.groupBy("hub").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts")), "queries")
        member = pairs.join(self._small(per), "hub").select("hub", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"), F.lit(0).alias("own"), "member")
        query = per.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(1).alias("own"), F.col("hub").alias("member"))
        who = self._small(self.scratch.save(member.unionByName(query), "who"))
        rows = sets.withColumnRenamed("rep", "member").join(who, "member").select("hub", "salt", "own", "member", "n", "blob")
        return deal(rows, "hub", "salt").sortWithinPartitions("hub", "salt", F.desc("own"))

    def _verify(self, pairs: DataFrame) -> DataFrame:
        sc = self.scratch
        near = self._attach(pairs, self.reps.select("rep", "n", F.col("first").alias("blob"))).mapInArrow(_search(self.percent, False), "src long, dst long")
        near = sc.save(near.select(F.col("src").alias("hub"), F.col("dst").alias("member")), "near")
        full = self._whole(near.select(F.explode(F.array("hub", "member")).alias("doc_id")).distinct())
        links = sc.save(self._attach(near, full).mapInArrow(_search(self.percent, True), "src long, dst long"), "verified")
        sc.drop(full)
        return links

    def rows(self) -> DataFrame:
        """doc_id, n_shingles, component_id, class_id for each row of the documents."""
        named = self.classes.join(self.components, F.col("rep") == F.col("id"), "left").select("n", "d1", "d2", "rep", F.coalesce("component", "rep").alias("component_id"))
        got = self.sets.select("doc_id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
        mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        return got.select("doc_id", F.col("n").alias("n_shingles"), mine.alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("class_id"))


def ngram_join(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    return NgramJoin(documents, n, percent).rows()


def keep_one(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents whose doc_id is the smallest of its component; rows without a set all stay.

    Of rows that repeat a doc_id in such a component all stay or all go."""
    join = NgramJoin(documents, n, percent)
    gone = join.scratch.save(join.rows().where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    # Qualified, so that no other column's name can clash.
    left, right = documents.alias("_all"), gone.alias("_gone")
    right = F.broadcast(right) if gone.count() <= BROADCAST_IDS else right
    return left.join(right, F.col("_all.doc_id") == F.col("_gone.doc_id"), "left_anti")
