"""Token counts of whole texts by heap-and-linked-list byte-pair merging; no identifiers are made.

A text is cut at the strings of the model's special tokens (one token each), what lies
between into words by the model's pattern, and each word into its UTF-8 bytes, one symbol
each. The symbols form a linked list; a heap holds each adjacent pair that can merge, by
rank, then place. The lowest is popped; it merges if both of its symbols are still those it
was pushed with, and the pairs with its neighbours are pushed. A word's count is its
initial symbols minus its merges, so a word of n bytes takes n log n steps.

The count of a word depends on the word alone. Workers keep the counts of short words in
two tables of ``TABLE`` each: memory is bounded, and nothing is shuffled. A text without
runs of white space is looked up by what stands between its spaces, which begin words;
long texts are cut into words one by one and never held as a list.

Null texts have 0 bytes and 0 tokens, as empty ones; null and repeated ids keep their rows.
White space counts as the pattern has it. Words may have any length; they are not cut. An
empty table gives no rows. Only the named columns are read. The bytes of a text are those of its UTF-8.

The model is a file of byte-level BPE in the JSON format of the public tokenizers library,
a few MB whatever the corpus is, and broadcast. Others (normalised text, a space in front,
special tokens that take up white space, fused or unknown symbols) are refused.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import shared
from .scratch import ship

MODEL = "/opt/tokenizers/byte_bpe_50k.json"
#: Words in a worker's table, and the length of the longest that is kept.
TABLE, LONGEST = 500_000, 64
#: Fixed value: the words that byte-level models of this format cut text into.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of more characters are cut into words one at a time.
LONG = 1 << 20
#: Runs of white space, by a wider notion of it than the pattern's.
RUNS = re.compile(r"\s\s")
#: The bits of a place in a heap entry.
PLACE = (1 << 32) - 1


def byte_letters() -> list[str]:
    """The character that stands for each byte in this format: itself where it prints, or else one from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


class Table(dict):
    """Counts of short strings; what isn't there yet is counted and kept. A full table becomes the older one, whose strings are taken over when they come again."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self.count, self.older = count, {}

    def __missing__(self, x: str) -> int:
        n = self.older.get(x) or self.count(x)
        if len(x) <= LONGEST:
            if len(self) >= TABLE:
                self.older = dict(self)
                self.clear()
            self[x] = n
        return n


class Counter:
    """Tokens of texts."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]], special: list[str]):
        self.symbols = [vocabulary[c] for c in byte_letters()]
        # By a pair of symbols (rank + 1) << 32, and by rank + 1 what they become.
        self.merges, self.whole = {}, [-1]
        for rank, (a, b) in enumerate(merges, 1):
            self.merges[vocabulary[a], vocabulary[b]] = rank << 32
            self.whole.append(vocabulary[a + b])
        self.spaced, self.bare = Table(self._spaced), Table(lambda word: self.merged(word.encode()))
        self.words = regex.compile(WORDS)
        # Of special strings that begin at one place the longest is taken.
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    @classmethod
    def parse(cls, raw: bytes) -> Counter:
        d = json.loads(raw)
        model, cut = d["model"], d["pre_tokenizer"] or {}
        plain = (
            model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and d["normalizer"] is None
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
            and not any(t[k] for t in d["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if not plain:
            raise ValueError("not a plain byte-level BPE model")
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        return cls(model["vocab"], merges, [t["content"] for t in d["added_tokens"]])

    def merged(self, word: bytes) -> int:
        """Tokens of a word: its bytes minus the merges. An entry of the heap is (rank + 1) << 32 | place."""
        symbol = list(map(self.symbols.__getitem__, word))
        n = len(symbol)
        find, whole_of, pop, push = self.merges.get, self.whole, heapq.heappop, heapq.heappush
        # The entry of the pair that begins at each place, 0 if it can't merge: an entry that is popped and not here is out of date.
        pair = [found | at if found else 0 for at, found in enumerate(map(find, zip(symbol, symbol[1:], strict=False)))]
        heap = [x for x in pair if x]
        if not heap:
            return n
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pair.append(0)
        done = 0
        while heap:
            entry = pop(heap)
            at = entry & PLACE
            if pair[at] != entry:
                continue
            done += 1
            symbol[at] = whole = whole_of[entry >> 32]
            right = after[at]
            pair[right] = pair[at] = 0
            after[at] = end = after[right]
            if end < n:
                before[end] = at
                if found := find((whole, symbol[end])):
                    pair[at] = found | at
                    push(heap, found | at)
            start = before[at]
            if start >= 0:
                if found := find((symbol[start], whole)):
                    pair[start] = found | start
                    push(heap, found | start)
                else:
                    pair[start] = 0
        return n - done

    def _word(self, word: str) -> int:
        return self.spaced[word[1:]] if word[0] == " " and len(word) > 1 else self.bare[word]

    def _spaced(self, x: str) -> int:
        """Tokens of x with a space in front."""
        words = self.words.findall(" " + x)
        return self.merged(words[0].encode()) if len(words) == 1 else sum(map(self._word, words))

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(map(self._count, parts))

    def _count(self, text: str) -> int:
        if len(text) > LONG:
            return sum(self._word(m[0]) for m in self.words.finditer(text))
        if RUNS.search(text):
            return sum(map(self._word, self.words.findall(text)))
        # A space between two characters that are no white space begins a word, whatever comes before.
        first, *others = text.split(" ")
        return sum(map(self._word, self.words.findall(first))) + sum(map(self.spaced.__getitem__, others))


#: Models that this worker has parsed, by the file's checksum; their tables serve all of its tasks.
_loaded: dict[int, Counter] = {}


def loaded(raw: bytes) -> Counter:
    key = zlib.crc32(raw)
    if key not in _loaded:
        _loaded[key] = Counter.parse(raw)
    return _loaded[key]


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 512, model: str = MODEL) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (more tokens than limit) of each row."""
    ship(documents.sparkSession)
    file = shared(documents.sparkSession, model)
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(file.value)
        for b in batches:
            found = [counter.count(t) if (t := x.as_py()) else 0 for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int64())], ["key", "n_bytes", "n_tokens"])

    kind = rows.schema["key"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
