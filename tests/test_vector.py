import numpy as np
import pytest

from corpusloom.operators import passing, vector


def brute(rows, asked, k):
    out = []
    for q, v in asked:
        near = sorted((float(((np.array(x) - np.array(v)) ** 2).sum()), i) for i, x in rows if x is not None and v is not None and len(x) == len(v))
        out += [(q, r, i, d) for r, (d, i) in enumerate(near[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("products", [1, 50, 1 << 21])
def test_search_equals_brute_force(spark, monkeypatch, products):
    monkeypatch.setattr(vector, "PRODUCTS", products)
    rng = np.random.default_rng(3)
    # Few distinct vectors, so that most distances tie; one in a third of all rows.
    rows = [(i, [float(v) for v in rng.integers(0, 2, 5)] if i % 3 else [1.0] * 5) for i in range(200)] + [(900 + i, [1.0, float(i)]) for i in range(4)] + [(990, None), (991, [])]
    asked = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(20)] + [(50, [0.0, 0.0]), (51, None), (52, [1.0] * 5), (53, [1.0] * 7)]
    index = spark.createDataFrame([(i, v, "x") for i, v in rows], "id long, vector array<float>, note string")
    queries = spark.createDataFrame([(i, [float(np.float32(x)) for x in v] if v else v) for i, v in asked], "query_id long, query_vector array<float>")
    for k in (1, 4, 300):
        got = sorted((r.query_id, r["rank"], r.id, r.distance) for r in vector.search(index, queries, k).collect())
        want = brute(rows, [(i, [float(np.float32(x)) for x in v] if v else v) for i, v in asked], k)
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=0)


def test_many_shards_and_empty_sides(spark):
    index = spark.range(500).selectExpr("id", "array(double(id), 1D) AS vector")
    asked = spark.createDataFrame([(7, [100.2, 1.0])], "query_id long, query_vector array<double>")
    met = passing.passed(index, asked, index["id"], lambda b: b.num_rows, lambda n, a: iter([passing.pa.RecordBatch.from_arrays([passing.pa.array([n] * a.num_rows)], ["n"])]), "n long", shard=50)
    shards = [r.n for r in met.collect()]
    assert len(shards) == 10 and sum(shards) == 500
    assert [r.id for r in vector.search(index, asked, 3).orderBy("rank").collect()] == [100, 101, 99]
    assert vector.search(index.limit(0), asked, 3).isEmpty() and vector.search(index, asked.limit(0), 3).isEmpty()


def test_keys_that_are_text(spark):
    index = spark.createDataFrame([("b", [1.0]), ("a", [1.0]), ("c", [0.5])], "id string, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, query_vector array<double>")
    assert [r.id for r in vector.search(index, asked, 2).orderBy("rank").collect()] == ["a", "b"]
