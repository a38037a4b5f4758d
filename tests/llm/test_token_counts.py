import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import token_counts
from corpusloom.llm.token_counts import MODEL, Counter, count_tokens

PARTS = ["a", "b", " ", "  ", "\n", "'s", "'ll", "é", "漢", "1", "22", "!", "?!", "<|endoftext|>", "<|endof", "\u0085", "\u001c", " ", " ", "the", " ing", "\t", "😀"]


@pytest.fixture(scope="module")
def counter():
    with open(MODEL, "rb") as f:
        return Counter.parse(f.read())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(MODEL)
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_every_character_as_the_library(counter, library):
    # Planes without characters yet are sampled.
    points = [p for p in [*range(0x20000), *range(0x20000, 0x110000, 61)] if not 0xD800 <= p < 0xE000]
    texts = ["".join(f"a{chr(p)}b {chr(p)} 1{chr(p)}{chr(p)} {chr(p)}  {chr(p)}." for p in points[lo : lo + 8]) for lo in range(0, len(points), 8)]
    assert [counter.count(t) for t in texts] == library(texts)


def test_random_texts_as_the_library(counter, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    assert [counter.count(t) for t in texts] == library(texts)


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=60).filter(lambda t: t.isascii() or all(not 0xD800 <= ord(c) < 0xE000 for c in t)))
def test_any_text_as_the_library(counter, library, text):
    assert counter.count(text) == library([text])[0]


def naive(merges, symbols):
    """Merges the lowest-rank pair, leftmost first, until none is left."""
    while True:
        ranked = [(merges[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in merges]
        if not ranked:
            return len(symbols)
        _, i = min(ranked)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_merges_as_a_plain_version():
    rng = random.Random(2)
    letters = token_counts.byte_letters()
    for _ in range(40):
        known, merges = list("abc"), []
        while len(merges) < 25:
            pair = rng.choice(known), rng.choice(known)
            if pair not in merges and len("".join(pair)) < 9:
                merges.append(pair)
                known.append("".join(pair))
        vocabulary = {c: i for i, c in enumerate(dict.fromkeys([*letters, *known]))}
        c = Counter(vocabulary, merges, [])
        for _ in range(30):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
            assert c.merged(word.encode()) == naive({m: i for i, m in enumerate(merges)}, list(word))


def test_long_words_and_texts(counter, library, monkeypatch):
    texts = ["ab" * 20_000, "x" * 30_000, "word " * 5000 + " \n " + "é" * 999, " " * 5000 + "a"]
    assert [counter.count(t) for t in texts] == library(texts)
    monkeypatch.setattr(token_counts, "LONG", 100)
    assert [counter.count(t) for t in texts] == library(texts)


def test_full_tables(library, monkeypatch):
    monkeypatch.setattr(token_counts, "TABLE", 20)
    with open(MODEL, "rb") as f:
        c = Counter.parse(f.read())
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randint(0, 99)}," for _ in range(50)) for _ in range(40)]
    assert [c.count(t) for t in texts] == library(texts)
    assert len(c.spaced) <= 20 and len(c.spaced.older) <= 20


def test_rows(spark):
    rows = [(1, "Hello world", 9), (None, "Hello world", 9), (2, None, 9), (3, "", 9), (1, "Hello world", 9), (4, "<|endoftext|>é", 9), (5, "word " * 600, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in count_tokens(df).collect()), key=repr)
    want = [(1, 11, 2, False), (None, 11, 2, False), (2, 0, 0, False), (3, 0, 0, False), (1, 11, 2, False), (4, 15, 2, False), (5, 3000, 601, True)]
    assert got == sorted(want, key=repr)
    assert count_tokens(df.limit(0)).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and count_tokens(df.limit(0)).isEmpty()
    assert [r["over_limit"] for r in count_tokens(df.where("doc_id = 5"), limit=601).collect()] == [False]


def test_other_models_are_refused():
    with open("/opt/tokenizers/word_bpe_49k.json", "rb") as f, pytest.raises(ValueError, match="byte-level"):
        Counter.parse(f.read())
