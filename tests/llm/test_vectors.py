import math

import numpy as np
import pytest

from corpusloom.llm import hash_forest, near_vectors

from .brute import reach

SCHEMA = "vec_id long, embedding array<float>, label int, extra string"


def rows_of(seed=0, n=260):
    r = np.random.default_rng(seed)
    base = r.normal(size=(30, 16))
    rows = []
    for i in range(n):
        v = base[r.integers(30)] + r.normal(size=16) * r.choice([0.0, 0.05, 0.12, 0.3])
        rows.append((i, [float(x) for x in np.float32(v * r.choice([1.0, 3.0]))], int(r.integers(3)), "x"))
    rows += [(n, None, 1, None), (n + 1, [0.0] * 16, 1, None), (n + 2, [float("nan")] * 16, 1, None), (n + 3, [1.0, None] * 8, 1, None), (n + 4, [], 1, None)]
    rows += [(n + 5, [1.0, 0.0], 1, None), (n + 6, [2.0, 0.0], 1, None), (n + 7, [1.0] * 16, None, None), (n + 8, [1.0] * 16, None, None), (n + 9, [float("inf")] * 16, 1, None), (None, rows[0][1], rows[0][2], None)]
    return rows


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    return math.fsum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))


def linked(rows, t):
    good = [(i, v, lab) for i, v, lab, _ in rows if i is not None and lab is not None and usable(v)]
    return [(a[0], b[0]) for k, a in enumerate(good) for b in good[:k] if a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= t]


@pytest.mark.parametrize(("block", "cell"), [(2048, 4096), (16, 20), (64, 1)])
def test_near_duplicates(spark, block, cell):
    rows = rows_of()
    links = linked(rows, 0.93)
    n = {}
    for a, b in links:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    label = reach([r[0] for r in rows if r[0] is not None], links)
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.93, block, cell).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        else:
            assert (r.n_links, r.component_id, r.kept) == (n.get(r.vec_id, 0), label[r.vec_id], label[r.vec_id] == r.vec_id), r


def test_repeated_vec_id(spark):
    """Each row counts the links of its own vector; the vectors of one id are one node."""
    rows = [(1, [1.0, 0.0], 0, None), (1, [0.0, 1.0], 0, None), (2, [1.0, 0.01], 0, None), (3, [0.01, 1.0], 0, None), (4, [0.0, 1.0], 0, None), (5, [1.0, 1.0], 0, None), (9, [-1.0, 0.0], 0, None), (9, [-1.0, -1.0], 0, None), (7, [-1.0, -1.0], 0, None)]
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.93).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1), (5, 0, 5), (7, 1, 7), (9, 0, 7), (9, 1, 7)]


def test_cells_on_small_tables(spark):
    """k-means cells at the smallest sizes; more where vectors lie in groups."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert near_vectors.near_duplicates(df, 0.93).first().cells >= 2
    r = np.random.default_rng(1)
    x = np.repeat(r.normal(size=(40, 16)), 60, axis=0) + 0.02 * r.normal(size=(2400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert len(near_vectors.best_centres(x, 150, 0.93)) >= 16


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_vectors.near_duplicates(empty).count() == 0
    assert hash_forest.nearest(empty).count() == 0


def test_visits_lose_no_pair():
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = near_vectors.spherical_kmeans(x, 12)
    home, visit = near_vectors.cells_of(x, centres, 0.9)
    a, b = np.nonzero(x @ x.T >= 0.9)
    assert visit[b, home[a]].all()


def recall(ids, x, got, k, every):
    found = total = 0
    for q, near in hash_forest.brute_force(ids, x, k, every):
        found += len(set(near.tolist()) & got.get(q, set()))
        total += len(near)
    return found / total


def test_forest_contract(spark):
    rows = rows_of(1)
    got = hash_forest.nearest(spark.createDataFrame(rows, SCHEMA), k=20, every=20).collect()
    vectors = {i: np.array(v, np.float64) for i, v, _, _ in rows if i is not None and usable(v)}
    by = {}
    for r in got:
        assert r.vec_id != r.query_id and r.query_id % 20 == 0
        assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), rel=1e-12)
        by.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    wanted = {i for i, v in vectors.items() if i % 20 == 0 and len(v) == 16}
    assert wanted <= set(by)
    for found in by.values():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(found) + 1))
        assert [f[1:] for f in found] == sorted(f[1:] for f in found)
    ids = np.array(sorted(i for i, v in vectors.items() if len(v) == 16))
    assert recall(ids, np.stack([vectors[i] for i in ids]), {q: {f[2] for f in v} for q, v in by.items()}, 20, 20) == 1.0


def test_forest_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in hash_forest.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = df.select("vec_id", "embedding").toPandas()
    assert recall(rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(np.float64), got, 20, 20) >= 0.9


def test_forest_small_shards(spark):
    rows = [(i, [float(i % 7 - 3), float(i % 5 - 2), 1.0], 0, None) for i in range(120)]
    got = hash_forest.nearest(spark.createDataFrame(rows, SCHEMA), k=5, every=20, shard=10, least=10**6).collect()
    x = np.array([r[1] for r in rows])
    want = {(q, rank, int(v)) for q, near in hash_forest.brute_force(np.arange(120), x, 5, 20) for rank, v in enumerate(near, 1)}
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == want


def test_forest_repeated_candidates(spark):
    rows = [(20, [1.0, 0.0], 0, None), (20, [1.0, 0.0], 0, None), (1, [3.0, 0.0], 0, None), (1, [3.0, 0.0], 0, None), (2, [1.0, 1.0], 0, None)]
    got = hash_forest.nearest(spark.createDataFrame(rows, SCHEMA), k=20, every=20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(20, 1, 1, 3.0), (20, 2, 1, 3.0), (20, 3, 2, 1.0)]
