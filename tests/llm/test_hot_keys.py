"""A key with most of the rows must not fill the bounded training samples."""

import numpy as np

from corpusloom.llm import quality, url_filter


def test_quality_hot_document_and_label(spark):
    text = {1: "plain words in a calm line of text here ", 0: "BUY!! NOW!! %%% $$$ "}
    ids = [r.id for r in spark.range(1, 400).where(~quality.held_out("id")).orderBy(quality.F.xxhash64("id")).collect()]
    # The id with the smallest hash has most of the rows and of the labels.
    rows = [(i, text[n % 2] * (n % 5 + 1)) for n, i in enumerate(ids)] + [(ids[0], text[0])] * 2000
    labels = [(i, n % 2) for n, i in enumerate(ids)] + [(ids[0], 0)] * 2000
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), spark.createDataFrame(labels, "doc_id long, quality int")
    by = {r.doc_id: r.predicted for r in quality.classify(docs, labels, max_train=200).collect()}
    assert np.mean([by[i] == n % 2 for n, i in enumerate(ids)]) > 0.98


def test_url_hot_copies(spark):
    known = [(f"http://{'spam' if n % 2 else 'site'}{n}.net/{'1/2/3/4?a=1&b=2' if n % 2 else 'about'}", 1 - n % 2) for n in range(400)]
    hot = known[hottest(spark, known)]
    model = url_filter.UrlFilter(spark.createDataFrame(known + [hot] * 2000, "url string, allow int"), max_train=300)
    assert model.constant is None
    pages = spark.createDataFrame(list(enumerate(u for u, _ in known)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in model.verdicts(pages, ()).collect()}
    assert np.mean([(got[n] == "allow") == bool(y) for n, (_, y) in enumerate(known)]) > 0.97


def hottest(spark, known):
    """Place of the url with the smallest hash."""
    df = spark.createDataFrame([(n, u) for n, (u, _) in enumerate(known)], "n int, url string")
    return df.orderBy(url_filter.F.xxhash64("url")).first().n
