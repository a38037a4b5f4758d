import numpy as np
import pytest

from corpusloom.llm import whitening
from corpusloom.llm.whitening import lanczos, whiten

SCHEMA = "vec_id long, embedding array<float>"


def symmetric(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        np.arange(60, 0, -1.0),
        0.5 ** np.arange(60),
        np.r_[np.full(20, 5.0), np.full(40, 1.0)],  # an eigenvalue that repeats more often than a block is wide
        np.full(60, 3.0),
        np.r_[np.full(3, 2.0), np.zeros(57)],
        np.zeros(60),
    ],
)
@pytest.mark.parametrize("block", [1, 4, 16])
def test_lanczos(values, block):
    a = symmetric(values)
    got, u = lanczos(lambda q: a @ q, 60, 12, block)
    assert np.allclose(got, np.sort(values)[::-1][:12], rtol=0, atol=1e-12 * max(1, values.max()))
    assert np.abs(u.T @ u - np.eye(12)).max() < 1e-12
    assert np.linalg.norm(a @ u - u * got, axis=0).max() < 1e-11 * max(1, values.max())


def test_lanczos_stops_before_the_whole_space():
    a, passes = symmetric(0.5 ** np.arange(200)), []
    lanczos(lambda q: passes.append(q.shape[1]) or a @ q, 200, 8, 8)
    assert sum(passes) < 100


def vectors(spark, n=300, d=40):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, d)) * np.linspace(3, 0.2, d) + 5
    x[7] = x[8]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_as_numpy(spark):
    rows, df = vectors(spark)
    extra = [(900, None), (901, [1.0, None] * 20), (902, [float("nan")] * 40), (903, [float("inf")] * 40), (904, [1.0, 2.0]), (905, []), (None, [0.0] * 40), (3, [2.0] * 40)]
    got = whiten(df.unionByName(spark.createDataFrame(extra, SCHEMA)).repartition(5), components=32).toPandas()
    kept = [*rows, (None, [0.0] * 40), (3, [2.0] * 40)]
    x = np.floor(64 * np.array([r[1] for r in kept], np.float64)).astype(np.int64) + 1_000_000
    n = len(x)
    assert set(got["n"]) == {n} and len(got) == n * 32
    c = x - x.mean(0)
    values, u = np.linalg.eigh(c.T @ c / n)
    values, u = values[::-1], u[:, ::-1]
    deviation = ((n * x - x.sum(0)) ** 2).sum(1)
    by = got.sort_values(["deviation", "vec_id", "component"])
    order = sorted(range(n), key=lambda i: (deviation[i], float("inf") if kept[i][0] is None else kept[i][0]))
    assert by["deviation"].to_numpy().reshape(n, 32)[:, 0].tolist() == deviation[order].tolist()
    z, mine = by["whitened"].to_numpy().reshape(n, 32), (c @ u[:, :32] / np.sqrt(values[:32]))[order]
    assert np.abs(np.abs(z) - np.abs(mine)).max() < 1e-9
    signs = np.sign((z * mine).sum(0))
    assert np.abs(z - mine * signs).max() < 1e-9
    assert np.allclose(by["explained"].to_numpy()[:32], values[:32] / values.sum(), rtol=1e-12)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10


def test_fewer_components(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], SCHEMA)
    got = whiten(df).toPandas()
    assert set(got["component"]) == {1} and abs(got["explained"][0] - 1) < 1e-12
    assert abs((got["whitened"] ** 2).mean() - 1) < 1e-12


def test_no_variance(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for df in (same, same.limit(1), same.limit(0), spark.createDataFrame([(1, None), (2, [])], SCHEMA)):
        got = whiten(df)
        assert got.columns == names and got.isEmpty()


def test_too_large(spark):
    with pytest.raises(OverflowError):
        whiten(spark.createDataFrame([(1, [1e11, 0.0]), (2, [0.0, 1.0])], SCHEMA))
    with pytest.raises(Exception, match="too large"):
        whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0])], SCHEMA))


def test_clashing_columns(spark):
    _, df = vectors(spark, 50, 6)
    more = df.selectExpr("*", "1 AS n", "'a' AS x", "2 AS component", "3 AS pos", "4 AS w")
    same = lambda d: sorted(map(tuple, whiten(d).drop("whitened", "explained", "identity_error").collect()))
    assert same(more) == same(df)


def test_offsets_lose_nothing():
    fit = whitening.Fit(3, [3_000_000_000_000_001] * 2, np.ones(1), np.zeros((2, 1)))
    assert fit.deviations(np.array([[1_000_000_000_000_000, 1_000_000_000_000_001]])).tolist() == [[-1, 2]]
