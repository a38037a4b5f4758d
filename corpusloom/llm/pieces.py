"""SentencePiece encoding and decoding: the N best segmentations over the piece lattice.

The model file gives pieces and scores. A segmentation's score is the sum of the scores
of its pieces; a character that no piece holds is one piece of the lowest score minus
``UNKNOWN_PENALTY``, written as its UTF-8 byte pieces if the model has byte fallback, and
as the unknown piece if not. (If it has byte pieces, decoding gives back every text, up
to the normalisation named below.)

A forward Viterbi pass gives each place in the text the best score from the start. They
are exact heuristics for a backward A-star search from the end, which so expands best
paths only and yields segmentations in order, best first. Paths of equal score come in
the order of their pieces from the end, longer pieces first.

No piece holds a space but at its start, so the lattice falls apart at spaces: each
word has a lattice of its own. The forward pass runs over many words at once, with the
two best scores at each place, and is kept in a table of bounded size. In the N best of
a text only the N - 1 words whose second best loses least can change: those get the
A-star search, and a heap draws the N best sums over them.

Normalisation: none of the text is changed or dropped. A space is added in front, as
the model's own encoder does, and every space becomes the piece mark U+2581. (A text
that holds U+2581 itself decodes to spaces there.) Null texts have null ids; empty
ones one empty segmentation; null document ids stay null. An empty table gives no rows;
extra columns are ignored. Long words are cut nowhere. Repeated rows are encoded each.
"""

from __future__ import annotations

import heapq
import itertools
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words in a worker's table. A full one becomes the older table, from which words that come again are taken over.
TABLE = 500_000
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at : at + n]
            at += n


class Known:
    """Finds pieces and their beginnings by a 64-bit hash of their code points, for arrays of strings at once.

    Two direct tables: what collides in the first lies in the second, whose bits are
    chosen so that nothing collides there."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    BITS = 20
    NONE, BEGINNING = -2, -1

    def __init__(self, ids: dict[str, int]):
        held = {name[:k]: self.BEGINNING for name in ids for k in range(1, len(name))} | ids
        self.hashes = np.array([self.of(n) for n in held] or [1], np.uint64)
        self.ids = np.array(list(held.values()) or [self.NONE], np.int32)
        slots = self.slot(self.hashes, 0)
        lone = np.unique(slots, return_index=True)[1]
        rest = np.setdiff1d(np.arange(len(self.hashes)), lone)
        for self.turn in range(1, 10_000):
            again = self.slot(self.hashes[rest], self.turn)
            if len(np.unique(again)) == len(rest):
                break
        self.first, self.second = self._table(slots[lone], lone), self._table(again, rest)

    def _table(self, slots: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and id by slot; an empty slot has a hash of 0, which no piece has."""
        h, i = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, self.NONE, np.int32)
        h[slots], i[slots] = self.hashes[which], self.ids[which]
        return h, i

    @staticmethod
    def slot(h: np.ndarray, turn: int) -> np.ndarray:
        return ((h * np.uint64(0xBF58476D1CE4E5B9 + 2 * turn)) >> np.uint64(64 - Known.BITS)).astype(np.int64)

    @classmethod
    def step(cls, h: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Hash of a string with one more character, from its hash and the character."""
        h = (h ^ code) * cls.BASE
        return h ^ (h >> np.uint64(29))

    @classmethod
    def of(cls, name: str) -> int:
        h, most = 1, (1 << 64) - 1
        for c in name:
            h = ((h ^ ord(c)) * int(cls.BASE)) & most
            h ^= h >> 29
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids, BEGINNING for what only begins pieces, NONE for anything else."""
        at = self.slot(h, 0)
        held = self.first[0][at]
        out = np.where(held == h, self.first[1][at], self.NONE)
        miss = np.flatnonzero((held != h) & (held != 0))
        if len(miss):
            at = self.slot(h[miss], self.turn)
            out[miss] = np.where(self.second[0][at] == h[miss], self.second[1][at], self.NONE)
        return out


@dataclass
class Pieces:
    """The pieces of a model: ids and scores of those that segment text, and the byte pieces.

    A word's entry in the table is (best score, its ids as little-endian 32-bit bytes,
    loss of the second best, infinite if there is none)."""

    names: list[str]
    kinds: list[int]
    ids: dict[str, int]
    scores: list[float]
    unknown: int
    byte_ids: dict[int, int]
    longest: int
    worst: float
    table: dict[str, tuple[float, bytes, float]] = field(default_factory=dict)
    older: dict[str, tuple[float, bytes, float]] = field(default_factory=dict)
    nbest: dict[tuple[str, int], list[tuple[float, bytes]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.known = Known(self.ids)
        self.score_of = np.array([*self.scores, self.worst])
        # Byte pieces beyond ASCII decode to lone surrogates first, which stand for their bytes.
        self.texts = ["" if k == CONTROL else chr(int(n[3:5], 16) + (0xDC00 if int(n[3:5], 16) > 127 else 0)) if k == BYTE else n.replace(MARK, " ") for n, k in zip(self.names, self.kinds, strict=True)]

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, raw: bytes) -> Pieces:
        names, scores, kinds = [], [], []
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                names.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
        usable = {n: i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k in (NORMAL, USER)}
        byte_ids = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == BYTE}
        if any(MARK in n.lstrip(MARK) for n in usable):
            raise ValueError("a piece holds a space inside: words can't be segmented by themselves")
        return cls(names, kinds, usable, scores, kinds.index(UNKNOWN), byte_ids, max(map(len, usable)), min(scores[i] for i in usable.values()) - UNKNOWN_PENALTY)

    def lattice(self, word: str) -> list[list[tuple[int, int, float]]]:
        """For each end in word the pieces (start, id, score) that end there, longer ones first; id -1 is unknown."""
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(word) + 1)]
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                i = self.ids.get(word[start:end])
                if i is not None:
                    out[end].append((start, i, self.scores[i]))
            if not out[end] or out[end][-1][0] != end - 1:
                out[end].append((end - 1, -1, self.worst))
        return out

    def best_of_word(self, word: str, n: int) -> list[tuple[float, bytes]]:
        """Up to n best (score, ids) of a word, best first: Viterbi forward, A-star backward.

        Among equal estimates the latest and longest piece goes on first, so equal paths
        come in the order of their pieces from the end, longer first."""
        edges = self.lattice(word)
        best = [0.0] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            best[end] = max(best[start] + s for start, _, s in edges[end])
        out: list[tuple[float, bytes]] = []
        turn = itertools.count(0, -1)
        heap: list[tuple] = [(-best[-1], next(turn), len(word), 0.0, None)]
        while heap and len(out) < n:
            _, _, at, done, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    (start, i, stop), path = path
                    ids += [i] if i >= 0 else self.spelled(word[start:stop])
                out.append((done, np.array(ids, "<i4").tobytes()))
                continue
            for start, i, s in reversed(edges[at]):
                heapq.heappush(heap, (-(done + s + best[start]), next(turn), start, done + s, ((start, i, at), path)))
        return out

    def solve(self, words: list[str]) -> None:
        """Puts words into the table, words of a length at once."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            for lo in range(0, len(group), 8192):
                self._solve(length, group[lo : lo + 8192])

    def _solve(self, length: int, words: list[str]) -> None:
        m = len(words)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(m, length).T.astype(np.uint64)
        # What follows the space that each word begins with.
        mark = Known.step(np.ones(1, np.uint64), np.uint64(ord(MARK)))
        total = length + 1
        best, second = np.full((total + 1, m), -np.inf), np.full((total + 1, m), -np.inf)
        best[0] = 0
        back, piece = np.zeros((total + 1, m), np.int32), np.zeros((total + 1, m), np.int32)
        # Forward from each start, along words where a piece may still go on. Starts ascend, so that of equal paths the longest last piece stays.
        every = np.arange(m)
        for start in range(total):
            rows, h = every, np.ones(m, np.uint64)
            for end in range(start + 1, min(total, start + self.longest) + 1):
                h = np.broadcast_to(mark, m) if end == 1 else Known.step(h, code[end - 2] if rows is every else code[end - 2][rows])
                i = self.known.find(h)
                if end == start + 1:
                    at, i1 = every, np.maximum(i, -1)  # a character by itself is unknown if it is no piece
                else:
                    hit = i >= 0
                    at, i1 = rows[hit], i[hit]
                s = self.score_of[i1]
                had, before = best[end][at], best[start][at]
                got = before + s
                more = got > had
                second[end][at] = np.maximum(np.where(more, had, np.maximum(second[end][at], got)), second[start][at] + s)
                better = at[more]
                best[end][better], back[end][better], piece[end][better] = got[more], start, i1[more]
                alive = i != Known.NONE
                rows, h = rows[alive], h[alive]
                if not len(rows):
                    break
        at = np.full(m, total)
        steps = []
        while at.any():
            steps.append(np.where(at > 0, piece[at, every], -2))
            steps.append(np.where(at > 0, at, 0))
            at = np.where(at > 0, back[at, every], 0)
        path = np.stack(steps[::2][::-1], 1)
        odd = (path == -1).any(1)
        first = (path == -2).sum(1)
        width = path.shape[1]
        raw = path.astype("<i4").tobytes()
        loss = np.where(second[total] > -np.inf, best[total] - second[total], np.inf).tolist()
        for k, (w, score, left, strange, lost) in enumerate(zip(words, best[total].tolist(), first.tolist(), odd.tolist(), loss, strict=True)):
            ids = raw[4 * (k * width + left) : 4 * (k + 1) * width]
            self.table[w] = (score, self._spell(MARK + w, ids) if strange else ids, lost)

    def _spell(self, word: str, ids: bytes) -> bytes:
        """ids with the byte pieces of unknown characters in place of -1."""
        out, at = [], 0
        for i in np.frombuffer(ids, "<i4").tolist():
            out += [i] if i >= 0 else self.spelled(word[at])
            at += len(self.names[i]) if i >= 0 else 1
        return np.array(out, "<i4").tobytes()

    def spelled(self, char: str) -> list[int]:
        raw = char.encode("utf-8", "surrogatepass")
        return [self.byte_ids[b] for b in raw] if all(b in self.byte_ids for b in raw) else [self.unknown]

    def words(self, text: str) -> list[str]:
        """The words of a text, each without the one mark that begins it; further spaces are marks."""
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, marks = [], -1
        for p in parts:
            marks += 1
            if p:
                out.append(MARK * marks + p)
                marks = -1
        return [*out, MARK * marks] if marks >= 0 else out

    def encode(self, texts: list[str], n: int) -> Iterator[list[tuple[float, bytes]]]:
        """For each text its n best (score, ids), best first."""
        split = [self.words(t) if t else [] for t in texts]
        if len(self.table) > TABLE:
            self.older, self.table, self.nbest = self.table, {}, {}
        missing = set().union(*split).difference(self.table)
        again = missing.intersection(self.older)
        self.table.update(zip(again, map(self.older.__getitem__, again), strict=True))
        self.solve(list(missing - again))
        for words in split:
            yield self._compose(words, n)

    def _compose(self, words: list[str], n: int) -> list[tuple[float, bytes]]:
        if not words:
            return [(0.0, b"")]
        scores, parts, losses = zip(*map(self.table.__getitem__, words), strict=True)
        base = sum(scores)
        out = [(base, b"".join(parts))]
        if n == 1:
            return out
        # A change costs at least its word's loss, so only the n - 1 words that lose least change in the n best.
        left, free = list(losses), []
        while len(free) < n - 1 and (lost := min(left)) < np.inf:
            free.append(left.index(lost))
            left[free[-1]] = np.inf
        lists = []
        for k in free:
            w = words[k]
            if (w, n) not in self.nbest:
                self.nbest[w, n] = self.best_of_word(MARK + w, n)
            lists.append(self.nbest[w, n])
        heap = [(0.0, (0,) * len(free))]
        seen = {heap[0][1]}
        while heap and len(out) < n + 1:
            loss, choice = heapq.heappop(heap)
            mine = list(parts)
            for k, c, alternatives in zip(free, choice, lists, strict=True):
                mine[k] = alternatives[c][1]
            out.append((base - loss, b"".join(mine)))
            for j, alternatives in enumerate(lists):
                c = choice[j] + 1
                if c < len(alternatives):
                    after = (*choice[:j], c, *choice[j + 1 :])
                    if after not in seen:
                        seen.add(after)
                        heapq.heappush(heap, (loss + alternatives[c - 1][0] - alternatives[c][0], after))
        return out[1:]

    def decode(self, ids: list[int]) -> str:
        text = "".join(map(self.texts.__getitem__, ids))
        try:
            text.encode()
        except UnicodeEncodeError:
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text.removeprefix(" ")


#: Models that this worker has parsed, by the file's checksum; their tables serve all of its tasks.
_loaded: dict[int, Pieces] = {}


def shared(spark: SparkSession, path: str) -> Broadcast:
    """The model file, some hundred KB, for all workers: only the driver, or else Spark, has to reach it."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return spark.sparkContext.broadcast(f.read())
    return spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(path).first()["content"]))


def loaded(model: Broadcast) -> Pieces:
    key = zlib.crc32(model.value)
    if key not in _loaded:
        _loaded[key] = Pieces.parse(model.value)
    return _loaded[key]


def _groups(column: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of consecutive rows of about so many characters."""
    at, held, size = 0, [], 0
    for i, x in enumerate(column):
        held.append(x.as_py())
        size += len(held[-1] or "")
        if size >= most:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def _each(pieces: Pieces, b: pa.RecordBatch, n: int) -> Iterator[list[tuple]]:
    """Lists of (doc_id, rank, score, ids as bytes, text); null texts have null score and ids."""
    for first, texts in _groups(b.column(1)):
        found = pieces.encode([t or "" for t in texts], n)
        out = []
        for doc, text, best in zip(b.column(0)[first : first + len(texts)].to_pylist(), texts, found, strict=True):
            out += [(doc, 1, None, None, None)] if text is None else [(doc, rank, score, ids, text) for rank, (score, ids) in enumerate(best, 1)]
        yield out


def encode(documents: DataFrame, n: int = 4, model: str = MODEL) -> DataFrame:
    """doc_id, rank (from 1), score, ids for the n best segmentations of each text."""
    ship(documents.sparkSession)
    file = shared(documents.sparkSession, model)
    schema = pa.schema([("doc_id", pa.int64()), ("rank", pa.int32()), ("score", pa.float64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in _each(loaded(file), b, n):
                cols = [[r[k] for r in rows] for k in range(3)]
                cols.append([None if r[3] is None else np.frombuffer(r[3], "<i4") for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, rank int, score double, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with ids in place of which there is ``text``; null ids give a null text."""
    ship(encoded.sparkSession)
    file = shared(encoded.sparkSession, model)
    others = [c for c in encoded.columns if c not in ("ids", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else loaded(file).decode(x) for x in b.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(texts, pa.string())], [*others, "text"])

    kept = encoded.select(*others, "ids")
    fields = [f for f in kept.schema.fields if f.name != "ids"]
    return kept.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType())]))


def round_trip(documents: DataFrame, n: int = 4, model: str = MODEL) -> DataFrame:
    """doc_id, rank, score, n_pieces, ids_hash and whether decoding gives the text back, for the n best of each text."""
    ship(documents.sparkSession)
    file = shared(documents.sparkSession, model)
    schema = pa.schema([("doc_id", pa.int64()), ("rank", pa.int32()), ("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_crc", pa.int64()), ("decodes", pa.bool_())])

    def checked(pieces: Pieces, rows: list[tuple]) -> Iterator[tuple]:
        """The best segmentation is decoded whole; of the others, which share the rest with it, what differs."""
        for doc, rank, score, ids, text in rows:
            if ids is None:
                yield doc, rank, None, None, None, None
                continue
            if rank == 1:
                best = np.frombuffer(ids, "<i4")
                back = pieces.decode(best.tolist())
                good = back == text or back == text.replace(MARK, " ")
                same = good
            else:
                mine = np.frombuffer(ids, "<i4")
                m = min(len(best), len(mine))
                head = np.flatnonzero(best[:m] != mine[:m])
                lead = int(head[0]) if len(head) else m
                tail = np.flatnonzero(best[lead:][::-1][: m - lead] != mine[lead:][::-1][: m - lead])
                end = int(tail[0]) if len(tail) else m - lead
                part = ["".join(map(pieces.texts.__getitem__, x[lead : len(x) - end].tolist())) for x in (best, mine)]
                same = good and part[0] == part[1]
            yield doc, rank, score, len(ids) // 4, zlib.crc32(ids), same

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(file)
        for b in batches:
            for rows in _each(pieces, b, n):
                cols = zip(*checked(pieces, rows), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, rank int, score double, n_pieces long, ids_crc long, decodes boolean")
