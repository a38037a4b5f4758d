import inspect

import numpy as np
import pytest

from corpusloom.llm import hash_forest

from .test_vectors import recall


@pytest.mark.parametrize("sigma", [0.0, 0.05, 0.25, 0.5])
def test_full_shard_without_structure(spark, sigma):
    r = np.random.default_rng(11)
    x = r.normal(size=(hash_forest.SHARD, 64))
    x *= np.exp(sigma * r.normal(size=(len(x), 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    got = {}
    for row in hash_forest.nearest(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>"), every=40).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    assert recall(ids, x, got, 20, 40) >= (0.9 if sigma else 0.93)


def test_candidates_are_few_and_distinct():
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    met = hash_forest.Forest(x, 1.0, 64, 16).candidates(x[:50], 400, 8)
    assert all(len(set(m.tolist())) == len(m) == 400 for m in met)
    # Those that most trees hold: nearer than the rest.
    assert np.mean([(x[m] @ q).mean() for m, q in zip(met, x[:50], strict=True)]) > 0.2


def test_share_of_rows_scored():
    """Under 20 % of the rows of a band, by the production parameters."""
    p = inspect.signature(hash_forest.nearest).parameters
    assert p["share"].default < 0.2 and p["least"].default < 0.2 * 2000
