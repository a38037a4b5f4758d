import random
import re

import pytest

from corpusloom.llm import licenses


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(text, templates, containment):
    """Templates contained in some run of the text of 2c shingles that starts at a multiple of c."""
    w, found = words(text), {}
    for name, t in templates.items():
        s = shingles(words(t))
        c = 1
        while c < len(s):
            c *= 2
        for at in range(0, max(1, len(w) - 4), c):
            share = len(s & shingles(w[at : at + 2 * c + 4])) / len(s)
            if share >= containment:
                found[name] = max(share, found.get(name, 0))
    return found


def test_matches_brute_force(spark):
    r = random.Random(0)
    filler = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(50)]
    rows = [(0, None, "c"), (1, "", "c"), (2, "Released under the MIT", "c"), (3, "word " * 20_000 + licenses.TEMPLATES["BSD-text"], "c")]
    for i in range(4, 90):
        text = [r.choice(filler) for _ in range(r.randint(0, 300))]
        for _ in range(r.randint(0, 2)):
            t = words(r.choice(list(licenses.TEMPLATES.values())))
            if r.random() < 0.4:
                t[r.randrange(len(t))] = "changed"
            at = r.randrange(len(text) + 1)
            text[at:at] = t
        rows.append((i, r.choice([" ", ", ", "\n"]).join(text), "c"))
    got = {}
    for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, containment string")).collect():
        got.setdefault(x.doc_id, {})[x.license] = x.containment
    want = {i: found for i, t, _ in rows if (found := brute(t, licenses.TEMPLATES, 0.8))}
    assert got == {i: {k: pytest.approx(v) for k, v in f.items()} for i, f in want.items()}
    assert len(want) > 30


def test_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, licenses.TEMPLATES["MIT"]), (1, licenses.TEMPLATES["MIT"]), (None, licenses.TEMPLATES["CC0"])], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.license, r.first_word) for r in licenses.scan(df).collect()) == [("1", "MIT", 0), ("1", "MIT", 0), ("None", "CC0", 0)]
    assert licenses.scan(df.limit(0)).count() == 0


def test_short_templates_are_refused(spark):
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), {"t": "too short"})


def test_runs_no_python(spark):
    plan = licenses.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
