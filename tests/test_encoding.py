import random

import pytest
from tokenizers import Tokenizer

from corpusloom.operators import encoding

TEXTS = ["", " ", "Hello world", "it's  a test\n\nof 1234 things...", "ñandú wasimanda runakuna-ta", "日本語 テキスト", "a<|endoftext|>b<|endoftext|>", "x" * 5000, "aaaa" * 40 + " ab" * 300]


def naive(encoder, word):
    ids = [encoder.single[b] for b in word.encode()]
    while True:
        best = min(((encoder.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in encoder.rank), default=None)
        if best is None:
            return tuple(ids)
        i = best[1]
        ids[i : i + 2] = [encoder.rank[ids[i], ids[i + 1]][1]]


@pytest.fixture(scope="module")
def encoder():
    with open(encoding.MODEL, "rb") as f:
        return encoding.Encoder(f.read())


def test_equals_naive(encoder):
    rng = random.Random(3)
    for _ in range(400):
        word = "".join(rng.choices(rng.choice(["ab", "the inga", "aeiouñá", "01 .,"]), k=rng.randrange(1, 60)))
        assert encoder.word(word) == naive(encoder, word)


def test_equals_library(spark, encoder):
    library = Tokenizer.from_file(encoding.MODEL)
    whole = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert [encoder.first_ids(t, 10**9) for t in TEXTS] == whole
    assert [encoder.first_ids(t, 5) for t in TEXTS] == [ids[:5] for ids in whole]
    rows = [(i, t, u, 7, None) for i, (t, u) in enumerate(zip(TEXTS, TEXTS[::-1]))] + [(99, None, "x", None, 8)]
    df = spark.createDataFrame(rows, "id int, src string, tgt string, s int, t int")
    got = encoding.encode_examples(df, "src", "tgt", pad=0, end=50256, starts=("s", "t"), length=128)
    for r in got.collect():
        ids = library.encode(r.src or "", add_special_tokens=False).ids
        head = [] if r.s is None else [r.s]
        want = head + ids[: 127 - len(head)] + [50256]
        assert r.input_ids == want + [0] * (128 - len(want)) and r.attention_mask == [1] * len(want) + [0] * (128 - len(want))
        ids = library.encode(r.tgt, add_special_tokens=False).ids
        head = [] if r.t is None else [r.t]
        want = head + ids[: 127 - len(head)] + [50256]
        assert r.labels == want + [-100] * (128 - len(want))


def test_refusals(spark):
    df = spark.createDataFrame([("a", "b")], "src string, tgt string")
    with pytest.raises(ValueError, match="no room"):
        encoding.encode_examples(df, "src", "tgt", pad=0, end=1, length=0)
    with pytest.raises(ValueError, match="labels"):
        encoding.encode_examples(df.withColumnRenamed("src", "labels"), "labels", "tgt", pad=0)
    with pytest.raises(ValueError, match="not a plain"):
        encoding.Encoder(b'{"model": {"type": "WordPiece"}, "pre_tokenizer": null, "normalizer": null}')
    assert encoding.encode_examples(df.limit(0), "src", "tgt", pad=0).count() == 0
