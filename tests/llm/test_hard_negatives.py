import numpy as np
import pytest

from corpusloom.llm import hard_negatives
from corpusloom.llm.hard_negatives import Rotated, hard_negatives as mined, mine, search

SCHEMA = "vec_id long, embedding array<float>, label long"


def brute(rows, every=100, k=5):
    """By all products, in Python's whole numbers."""
    good = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v], (g + 1) % 10 if i % 7 == 0 else g) for i, v, g in rows if None not in (i, v, g) and v and all(c is not None and np.isfinite(c) for c in v)]
    anchors = {(i, tuple(v), g) for i, v, g in good if i % every == 0}
    out = []
    for a, v, label in anchors:
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, g) for i, w, g in good if i != a and len(w) == len(v)]
        same = sorted(s[:2] for s in scored if s[2] == label)[:k]
        for p, pid in same:
            hard = sorted(s[:2] for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p)[:k]
            out += [(a, pid, r, nid, -p, -n) for r, (n, nid) in enumerate(hard, 1)]
    return sorted(out)


def made(seed=1, n=900, d=12, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, d)) * np.linspace(2, 0.1, d)
    rows = [(i, [float(np.float32(c)) for c in centres[i % 4] + spread * rng.normal(size=d)], int(i % 3)) for i in range(n)]
    same = rows[5][1]
    # A third of all rows are one vector, with all labels.
    return [(i, same if i % 3 == 0 else v, int(rng.integers(0, 3))) for i, v, g in rows]


def test_equals_brute_force(spark):
    odd = [(100, [1.0] * 12, 1), (100, [0.5] * 12, 1), (None, [1.0] * 12, 1), (2000, None, 1), (2100, [1.0] * 12, None), (2200, [float("nan")] * 12, 1), (2300, [None] * 12, 1), (2400, [0.0] * 12, 1), (2500, [2.0], 1), (2501, [3.0], 1), (2502, [1.9], 0), (2600, [], 0), (3, [1.0] * 12, 2), (3, [1.0] * 12, 2)]
    rows = made() + odd
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, mined(df).collect()))
    assert got == brute(rows) and len(got) > 100
    assert sorted(map(tuple, mined(df.selectExpr("*", "1 AS x", "2 AS no", "3 AS score", "4 AS r")).collect())) == got


def test_many_shards_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PAIRS", 500)
    rows = made(2, 400)
    df = spark.createDataFrame([(i, [int(np.floor(256 * c)) for c in v], (g + 1) % 10 if i % 7 == 0 else g) for i, v, g in rows], "vec_id long, x array<long>, label long")
    assert sorted(map(tuple, mine(df, shard=37).collect())) == brute(rows)


def test_empty(spark):
    got = mined(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and got.isEmpty()
    assert mined(spark.createDataFrame([(100, [1.0], 1), (3, None, None)], SCHEMA)).isEmpty()


def test_too_large(spark):
    with pytest.raises(OverflowError):
        mined(spark.createDataFrame([(1, [1e7] * 64, 1), (2, [1.0] * 64, 1)], SCHEMA)).collect()


def test_rotation_discards_early():
    """Where few components carry the products, few pairs are read beyond them; the result is that of all products."""
    rng = np.random.default_rng(6)
    x = np.floor(256 * rng.normal(size=(3000, 64)) * 0.8 ** np.arange(64)).astype(np.int64)
    x = np.floor(x @ np.linalg.qr(rng.normal(size=(64, 64)))[0]).astype(np.int64)
    turn = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    held, asked, seen = Rotated(x, turn), Rotated(x[:40], turn), []
    every = np.full((40, 1), np.inf)
    order = np.arange(len(x))
    i, _, j, score = search(asked, held, None, -every, every, 5, order, seen)
    assert seen[0] == 40 * 3000 and seen[2] < 0.1 * seen[0] and seen[-1] <= 1.1 * 200
    product = x[:40] @ x.T
    want = [np.lexsort((order, -p))[:5] for p in product]
    assert [j[i == a].tolist() for a in range(40)] == [w.tolist() for w in want]
    # Rounding: bounds of pairs hold under the slack.
    assert (score == product[i, j]).all()


def test_windows_are_exact():
    rng = np.random.default_rng(9)
    x = rng.integers(-300, 300, size=(500, 16))
    turn = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    product = x[:30] @ x.T
    high = np.sort(product, axis=1)[:, [-2, -9, 3]]
    low = -(-80 * high // 100)
    i, w, j, score = search(Rotated(x[:30], turn), Rotated(x, turn), None, low, high, 4, np.arange(500))
    for a in range(30):
        for b in range(3):
            inside = np.flatnonzero((product[a] >= low[a, b]) & (product[a] <= high[a, b]))
            want = inside[np.lexsort((inside, -product[a, inside]))][:4]
            assert j[(i == a) & (w == b)].tolist() == want.tolist()
