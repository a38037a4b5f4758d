import itertools
import random

import numpy as np
import pytest
import sentencepiece

from corpusloom.llm import pieces
from corpusloom.llm.pieces import MARK, Pieces


@pytest.fixture(scope="module")
def model():
    return Pieces.load()


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def as_unigram():
    """The same pieces and scores for the library's own unigram lattice."""
    raw = open(pieces.MODEL, "rb").read()
    out = b""
    for number, value in pieces._fields(raw):
        if number == 2:
            kept = b""
            for k, v in pieces._fields(value):
                if k == 3:
                    v = 1
                # Floats stay out: training parameters that encoding doesn't read.
                if isinstance(v, int) or k in (1, 2, 5, 7, 30, 31, 36, 44, 45, 46, 47, 48):
                    kept += field(k, v)
            value = kept
        out += field(number, value)
    return out


def all_paths(model, word):
    """Every segmentation of a word."""
    edges = model.lattice(word)
    out = []

    def back(at, total, path):
        if at == 0:
            out.append((total, [i for p in reversed(path) for i in p]))
        for start, i, s in edges[at]:
            back(start, total + s, [*path, [i] if i >= 0 else model.spelled(word[start:at])])

    back(len(word), 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def test_word_search_is_exact(model):
    r = random.Random(0)
    words = ["".join(r.choice("theisandé世▁") for _ in range(r.randint(1, 8))) for _ in range(80)]
    model.solve(words)
    for w in words:
        want = all_paths(model, MARK + w)
        got = model.best_of_word(MARK + w, 5)
        assert [g[0] for g in got] == [x[0] for x in want[:5]]
        assert model.table[w][:2] == got[0]
        assert model.table[w][2] == (want[0][0] - want[1][0] if len(want) > 1 else float("inf"))
        assert {tuple(np.frombuffer(g[1], "<i4")) for g in got} <= {tuple(x[1]) for x in want}
        assert len({g[1] for g in got}) == len(got)


def test_text_search_is_exact(model):
    for text in ("the cat sat", "a  b", "no", " lead and trail ", "日 é"):
        words = [MARK + w for w in model.words(text)]
        combos = sorted((sum(p[0] for p in c) for c in itertools.product(*(all_paths(model, w)[:6] for w in words))), reverse=True)
        model.solve(model.words(text))
        got = next(model.encode([text], 6))
        assert [g[0] for g in got] == pytest.approx(combos[:6])
        assert len({g[1] for g in got}) == len(got)


def test_agrees_with_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_proto=as_unigram())
    r = random.Random(4)
    # The library adds in single precision, so the texts have no piece of a score near -1e9 (a lone space mark).
    texts = [" ".join("".join(r.choice("theanisord") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 6))) for _ in range(80)] + ["The quick brown fox jumps over the lazy dog."]
    for text, got in zip(texts, model.encode(texts, 4), strict=True):
        want = library.nbest_encode_as_ids(text, 4)
        value = lambda ids: sum(model.scores[i] for i in ids)
        assert sorted((round(g[0]) for g in got), reverse=True) == sorted((round(value(w)) for w in want), reverse=True), text
        assert round(value(np.frombuffer(got[0][1], "<i4").tolist())) == round(value(want[0]))


def test_round_trip_of_odd_texts(model):
    texts = ["", " ", "   ", "\n\t\x00", "é世🙂", "a" * 3000, "x\u0301 \u200b", "<s> </s> <unk>", "  two  spaces  ", "\r\n"]
    for text, got in zip(texts, model.encode(texts, 3), strict=True):
        assert got
        assert all(model.decode(np.frombuffer(ids, "<i4").tolist()) == text for _, ids in got)


def test_tables_turn_over(monkeypatch, model):
    monkeypatch.setattr(pieces, "TABLE", 5)
    fresh = Pieces.load()
    texts = [f"word{i} the {i % 3}" for i in range(50)]
    assert [next(fresh.encode([t], 3)) for t in texts] == list(model.encode(texts, 3))


def test_operators(spark):
    rows = [(1, "some text here", "x"), (1, "some text here", "x"), (2, None, "x"), (3, "", "x"), (None, "é 世", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank string")
    coded = pieces.encode(df, 3)
    got = coded.collect()
    assert [r.rank for r in got if r.doc_id == 1] == [1, 2, 3, 1, 2, 3]
    assert [(r.rank, r.ids, r.score) for r in got if r.doc_id == 2] == [(1, None, None)]
    assert [r.ids for r in got if r.doc_id == 3] == [[]]
    back = {(r.doc_id, r.text) for r in pieces.decode(coded).collect()}
    assert back == {(i, t) for i, t, _ in rows}
    assert all(r.decodes in (True, None) for r in pieces.round_trip(df, 3).collect())
    assert pieces.encode(df.limit(0)).count() == pieces.round_trip(df.limit(0)).count() == 0


def test_whole_small_table(spark):
    got = pieces.round_trip(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), 3).collect()
    assert len(got) == 600 and all(r.decodes for r in got)
