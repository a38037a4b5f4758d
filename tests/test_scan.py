import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import scan
from corpusloom.operators.scan import Chapters, carried, fold, reachable, swept


def random_events(rng, n):
    return [(0, rng.randint(1, 20)) if rng.random() < 0.8 else (1, rng.randint(1, 12)) if rng.random() < 0.8 else (2, 0) for _ in range(n)]


STATES = [(c, m) for c in (1, 2, 5, 11, 40) for m in (0, 3, 6, 7, 12, 15, 19, 26, 40)]


def test_chapters_as_the_fold():
    rng = random.Random(1)
    for _ in range(1500):
        events = random_events(rng, rng.randint(0, 14))
        f = Chapters.of(events)
        for s in STATES:
            assert f(s) == fold(events, s)[-1], (events, s, f.ways)


def test_composition_and_packing():
    rng = random.Random(2)
    for _ in range(800):
        a, b, c = (random_events(rng, rng.randint(0, 8)) for _ in range(3))
        f, g, h = map(Chapters.of, (a, b, c))
        left, right = f.then(g).then(h), f.then(g.then(h))
        packed = Chapters.unpack(left.pack())
        for s in STATES:
            assert left(s) == right(s) == packed(s) == fold(a + b + c, s)[-1], (a, b, c, s)


def test_few_steps():
    rng = random.Random(3)
    events = [(0, rng.randint(1, 150)) for _ in range(4000)]
    assert len(Chapters.of(events).ways) <= scan.FALL + 2


@pytest.mark.parametrize("fan", [2, 3, 100])
def test_swept(spark, fan):
    rng = random.Random(4)
    rows, want = [], {}
    for g in range(3):
        state, n = (1, 0), 0
        for b in range(rng.randint(1, 30)):
            events = random_events(rng, rng.randint(0, 6))
            rows.append((g, b * 7, Chapters.of(events).pack()))
            want[g, b * 7] = (*state, fold(events, state)[-1][0])
            state = fold(events, state)[-1]
    got = swept(spark.createDataFrame(rows, "g int, block long, ways array<double>"), "g", fan)
    assert {(r.g, r.block): (r.chapter, r.most, r.chapter_after) for r in got.collect()} == want


@pytest.mark.parametrize("size", [1, 3, 50])
def test_carried(spark, size):
    rng = random.Random(5)
    rows = [(d, i, rng.choice([None, i, -i])) for d in range(3) for i in range(rng.randint(1, 40))]
    df = spark.createDataFrame(rows, "doc int, seq int, v int").withColumn("block", scan.block_of("seq", size))
    for inclusive, backward in itertools.product((True, False), (True, False)):
        got = carried(df, ["doc"], ["seq"], {"l": F.col("v")}, {"s": F.col("v")}, inclusive, backward)
        for r in got.collect():
            mine = [v for d, i, v in rows if d == r.doc and (i == r.seq and inclusive or (i > r.seq if backward else i < r.seq)) and v is not None]
            if backward:
                mine = mine[::-1]
            assert (r.l, r.s) == (mine[-1] if mine else None, sum(mine))


@pytest.mark.parametrize("size", [1, 4, 64])
def test_reachable(spark, size):
    rng = random.Random(6)
    rows, want = [], set()
    for d in ("x", "y"):
        n = rng.randint(30, 60)
        after = {i: (rng.randint(i + 1, min(n - 1, i + 9)) if i + 1 < n and rng.random() < 0.97 else None) for i in range(n)}
        rows += [(d, i, after[i]) for i in range(n)]
        at = 2
        while at is not None:
            want.add((d, at))
            at = after[at]
    df = spark.createDataFrame(rows, "doc string, seq int, after int").withColumn("block", scan.block_of("seq", size))
    starts = spark.createDataFrame([("x", 2), ("y", 2)], "doc string, seq int")
    assert {tuple(r) for r in reachable(df, starts).collect()} == want
