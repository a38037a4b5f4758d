import numpy as np

from corpusloom.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(200).select(quality.F.col("id").alias("doc_id"), quality.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_odd_rows_and_columns(spark):
    good = [(i, "plain words in a calm line of text here " * (i % 5 + 1), 0.5) for i in range(120)]
    bad = [(i, "BUY!! NOW!! %%% $$$ " * (i % 5 + 1), 0.5) for i in range(120, 240)]
    odd = [(None, "x", 0.5), (300, None, 0.5), (301, "", 0.5), (302, "word " * 50_000, 0.5), (5, good[5][1], 0.5)]
    df = spark.createDataFrame([*good, *bad, *odd], "doc_id long, text string, quality_score double")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)] + [(None, 1), (7, None), (999, 0)], "doc_id long, quality int")
    got = quality.classify(df, labels).collect()
    assert len(got) == 245
    by = {r.doc_id: r.predicted for r in got}
    assert np.mean([by[i] == int(i < 120) for i in range(240)]) > 0.98
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    assert {r.quality_score for r in kept.collect()} == {0.5}


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.classify(df, none).collect()] == [0.5, 0.5]
    assert quality.classify(df.limit(0), none).count() == 0


def plain_score(p, passages):
    """Gated attention of one bag, by sums over its passages."""
    h = [np.tanh(p["w"].T @ x) for x in passages]
    e = [p["a"] @ (np.tanh(p["v"].T @ k) / (1 + np.exp(-(p["u"].T @ k)))) for k in h]
    share = np.exp(e) / np.exp(e).sum()
    return 1 / (1 + np.exp(-(p["c"] @ sum(s * k for s, k in zip(share, h, strict=True)) + p["c0"][0])))


def test_scores_and_gradients_equal_plain_version():
    r = np.random.default_rng(2)
    p = {"w": r.normal(size=(6, 4)), "v": r.normal(size=(4, 4)), "u": r.normal(size=(4, 4)), "a": r.normal(size=4), "c": r.normal(size=4), "c0": np.array([0.3])}
    bags, y = [r.normal(size=(k, 6)) for k in (1, 3, 7, 2)], np.array([1.0, 0.0, 0.0, 1.0])
    x, count = np.concatenate(bags), np.array([len(b) for b in bags])
    got = quality.Model(p["w"], p["v"], p["u"], p["a"], p["c"], 0.3).scores(x, count)
    assert np.allclose(got, [plain_score(p, b) for b in bags])
    loss = lambda q: -np.mean([np.log(s if t else 1 - s) for s, t in zip([plain_score(q, b) for b in bags], y, strict=True)])
    grad = quality.gradients(p, x, count, y)
    for name, value in p.items():
        for at in np.ndindex(value.shape):
            up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            assert np.isclose(grad[name][at], (loss(up) - loss(down)) / 2e-6, atol=1e-6), (name, at)


def test_packed_bags_hold_whole_documents():
    data = np.frombuffer(b"Plain words, in 3 calm lines!\n" * 4000, np.uint8)
    x, count = quality.encode(data, np.array([0, len(data)]))
    assert count[0] > 700
    assert np.allclose(quality.unpacked(quality.packed(x)), x, atol=2e-3)
    assert len(quality.packed(x)) < 200 * count[0]


def test_gradients():
    """Analytic training lowers the loss; attention weights of a bag sum to 1."""
    r = np.random.default_rng(0)
    bags = [r.normal(size=(r.integers(1, 6), 8)) + np.eye(8)[0] * 4 * (k % 2) * (np.arange(1) == 0) for k in range(120)]
    y = np.array([k % 2 for k in range(120)], float)
    model = quality.train([b.astype(np.float16) for b in bags], y, width=8, epochs=250)
    x, count = np.concatenate(bags), np.array([len(b) for b in bags])
    s = model.forward(x, count)
    assert np.allclose(np.add.reduceat(s["weight"], s["at"]), 1)
    assert ((s["score"] >= 0.5) == y).mean() > 0.95
