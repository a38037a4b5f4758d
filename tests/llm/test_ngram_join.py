import random

import numpy as np
import pytest

from corpusloom.llm import graph, ngram_join
from corpusloom.llm.scratch import Scratch

from .brute import ngram_components, reach

SMALL = "/root/testdata/sf0.001"


def texts(seed, n=160):
    """Families of near copies, a passage that many share, and odd cases."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(12))
    bases = [[word() for _ in range(r.randint(5, 60))] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "two words"), (6, "Two\x0bWords"), (7, "é É"), (8, "x " * 3000)]
    for i in range(9, n):
        words = list(r.choice(bases))
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = word()
        text = " ".join(words)
        rows.append((i, text + " " + passage if r.random() < 0.4 else text))
    return rows


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 70, 3)])
def test_matches_brute_force(spark, n, percent, seed):
    rows = texts(seed)
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == ngram_components(rows, n, percent)


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ngram_join.ngram_join(docs, 3, 90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == ngram_components(rows, 3, 90)


def test_null_ids_repeats_and_extra_columns(spark):
    rows = [(None, "a b c", 1), (4, "a b c", 2), (4, "a b c", 3), (2, "A B C", 4), (None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df, 3, 90).collect())
    assert got == [("2", 1, 2), ("4", 1, 2), ("4", 1, 2), ("None", 0, None), ("None", 1, None)]
    kept = ngram_join.keep_one(df, 3, 90)
    assert kept.columns == ["doc_id", "text", "n"]
    assert sorted(r.n for r in kept.collect()) == [1, 4, 5]


def test_keep_one_clashing_names(spark):
    names = ("gone", "rep", "component_id", "n_shingles", "id", "_all", "_gone")
    rows = [(1, "a b c d", *[f"{c}1" for c in names]), (2, "a b c d", *[f"{c}2" for c in names]), (3, "x y z", *[f"{c}3" for c in names])]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    kept = ngram_join.keep_one(df, 3, 90)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_empty_table(spark):
    assert ngram_join.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_divide_skip_equals_counting():
    r = np.random.default_rng(5)
    for _ in range(200):
        q = np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint64))
        members = [np.unique(r.integers(0, 60, r.integers(0, 50)).astype(np.uint64)) for _ in range(r.integers(1, 12))]
        need = r.integers(1, 30, len(members))
        true = np.array([len(np.intersect1d(q, m)) for m in members])
        assert (ngram_join.divide_skip(q, members, need) == np.where(true >= need, true, 0)).all()


@pytest.mark.parametrize("one_task", [10, 10_000])
def test_components(spark, one_task):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(500, k) for k in range(501, 560)]
    got = graph.components(Scratch(spark, "t"), spark.createDataFrame([*links, (None, 3)], "src long, dst long"), one_task).collect()
    want = reach({x for e in links for x in e}, links)
    assert {x.id: x.component for x in got} == want and len(got) == len(want)
