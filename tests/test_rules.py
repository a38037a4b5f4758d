import math
import random
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import adapters, align, metrics, parsing, profile, prompt, quality, vector
from corpusloom.functions import tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(("text", "ok"), [(None, False), ("a b c d", False), ("a b c d e", True), ("1 2 3 a b c", True), ("1.5 2,0 3 4 a b c", False), ("", False)])
def test_valid_text(spark, text, ok):
    assert frame(spark, [(text,)], "x string").select(quality.valid_text(F.col("x")).alias("v")).first().v is ok


@pytest.mark.parametrize(("a", "b", "ok"), [("w " * 5, "w", True), ("w " * 6, "w", False), ("", "w", False), (None, "w", False)])
def test_word_ratio(spark, a, b, ok):
    assert frame(spark, [(a, b)], "a string, b string").select(quality.words_in_ratio(F.col("a"), F.col("b")).alias("v")).first().v is ok


@pytest.mark.parametrize(("score", "name"), [(0.02, "mixed"), (0.021, "inga"), (-0.05, "mixed"), (-0.051, "es"), (0.0, "mixed")])
def test_language(spark, score, name):
    assert frame(spark, [(score,)], "s double").select(quality.language(F.col("s")).alias("v")).first().v == name


def test_language_score(spark):
    rows = [("wasimanda runakuna-ta!", 1.0), ("de la casa", -2 / 3), ("...", 0.0), ("", 0.0)]
    got = frame(spark, rows, "x string, want double").select(quality.language_score(F.col("x")).alias("v"), "want").collect()
    assert all(r.v == pytest.approx(r.want) for r in got)


def test_looks_like(spark):
    got = frame(spark, [("runakuna a b c d e f g h i", "de la"), ("a", "de de"), ("", "")], "t string, s string").select(quality.looks_target(F.col("t")).alias("t"), quality.looks_source(F.col("s")).alias("s")).collect()
    assert [(r.t, r.s) for r in got] == [(True, True), (False, False), (False, False)]


def test_keep_first_and_align(spark):
    left = frame(spark, [("k", 2, "b"), ("k", 1, "a"), ("z", 3, "c")], "k string, seq int, v string")
    right = frame(spark, [("k", "r")], "k string, w string")
    assert [(r.k, r.v, r.w) for r in align.align(left, right, ["k"], ["seq"]).collect()] == [("k", "a", "r")]


@pytest.mark.parametrize("n", [0, 1, 9, 10, 5589, 5641])
def test_split_sizes(spark, n):
    got = {r.split: r["count"] for r in align.split(spark.range(n).withColumnRenamed("id", "idx"), "idx").groupBy("split").count().collect()}
    want = {"train": int(0.8 * n), "val": int(0.1 * n)}
    want["test"] = n - sum(want.values())
    assert got == {k: v for k, v in want.items() if v}


def test_numbers_are_dense(spark):
    got = align.number(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), ["k"]).collect()
    assert all(r.idx == r.k for r in got) and len(got) == 1000


def test_zip_and_follow(spark):
    got = frame(spark, [(["a", "b", "c"], ["x"])], "a array<string>, b array<string>").select(align.zip_arrays(F.col("a"), F.col("b")).alias("z")).first().z
    assert [tuple(x) for x in got] == [("a", "x")]
    rows = [(1, i, lab, f"t{i}") for i, lab in enumerate(["inga", "inga", "es", "es", "inga"])]
    got = align.follow(frame(spark, rows, "d int, seq int, lang string, text string"), ["d"], "seq", "lang", "inga", "es", "text").collect()
    assert [(r.a, r.b) for r in got] == [("t1", "t2")]


def test_sample_is_reproducible(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a, b = ([r.k for r in align.sample(df.repartition(n), "k", 20).collect()] for n in (1, 7))
    assert a == b and len(set(a)) == 20
    assert align.sample(df, "k", 9999).count() == 500


def test_first_alias(spark):
    table = tables.lookup(spark, {"SAN JUAN": "Juan", "1 SAN JUAN": "1 Juan"}, "alias", "canonical")
    got = align.first_alias(frame(spark, [("1 SAN JUAN X",), ("none",)], "t string"), "t", table).collect()
    assert [(r.t, r.canonical) for r in got] == [("1 SAN JUAN X", "Juan")]


def test_profile(spark):
    got = frame(spark, [("a b\n<!-- Page 1 -->\nc",)], "x string").select(*profile.document_profile(F.col("x"))).first()
    assert (got.chars, got.words, got.lines, got.pages) == (21, 7, 3, 1)
    h = profile.histogram(spark.range(0, 41).toDF("v"), "v").orderBy("bin").collect()
    assert [r.n for r in h] == [1] * 39 + [2]
    assert profile.histogram(frame(spark, [(3,), (3,)], "v int"), "v").first().n == 2
    cover = {r.libro: (r.canon, r.n, r.low) for r in profile.coverage(frame(spark, [("A", 10), ("B", 2)], "libro string, canon int"), frame(spark, [("A",)] * 9 + [("C",)], "libro string"), "libro", "canon").collect()}
    assert cover == {"A": (10, 9, False), "B": (2, 0, True), "TOTAL": (12, 9, True)}


RECORDS = "array<struct<lema: string, cat: string, glosa: string>>"


def test_prompts(spark):
    lex = [("a", "s", "b")] * 7
    gram = [("f", "x" * 500)] * 4
    ex = [("in", "es")] * 6
    df = frame(spark, [("frase", lex, gram, ex, [], [], [])], f"s string, l {RECORDS}, g array<struct<fuente: string, text: string>>, e array<struct<texto_inga: string, texto_es: string>>, l0 {RECORDS}, g0 array<struct<fuente: string, text: string>>, e0 array<struct<texto_inga: string, texto_es: string>>")
    of = lambda c: df.select(c.alias("p")).first().p
    assert of(prompt.prompt(F.col("s"), "es2inga")) == "Traduce esta oracion del espanol al Inga:\n\nfrase"
    full = of(prompt.prompt(F.col("s"), "inga2es", F.col("l"), F.col("g"), F.col("e")))
    parts = full.split("\n\n")
    assert parts[0].count("\n- ") == 5 and parts[1].count("\n- ") == 3 and parts[2].count("\n- INGA") == 5
    assert "x" * 400 in full and "x" * 401 not in full
    assert full.endswith("Traduce esta oracion del Inga al espanol:\n\nfrase")
    back = of(prompt.prompt(F.col("s"), "es2inga", F.col("l0"), F.col("g0"), F.col("e")))
    assert back.startswith("Ejemplos") and "- ESPANOL: es\n  INGA: in" in back
    assert of(prompt.prompt(F.col("s"), "inga2es", F.col("l0"), F.col("g0"), F.col("e0"))) == "\n\nTraduce esta oracion del Inga al espanol:\n\nfrase"
    assert of(prompt.refinement(F.col("s"), F.lit("d"))) == "frase\n\nTraduccion automatica preliminar a refinar:\nd\n\nVersino refinada:"
    assert of(prompt.system_prompt(F.lit("es2inga"))) == tables.SYSTEM_PROMPTS["es2inga"]


def pairs(spark, *rows):
    return frame(spark, list(rows), "r string, h string")


def test_bleu(spark):
    of = lambda *rows: metrics.bleu(pairs(spark, *rows), "r", "h").first().bleu
    assert of(("the cat sat on the mat.", "the cat sat on the mat.")) == pytest.approx(100)
    assert of(("a b c d", "x y z w")) == 0
    assert of(("a b", "")) == 0
    # 5 of 6, 3 of 5, 1 of 4 and none of 3 matches, smoothed once; equal lengths.
    want = 100 * math.exp((math.log(5 / 6) + math.log(3 / 5) + math.log(1 / 4) + math.log(1 / 6)) / 4)
    assert of(("the cat sat on the mat", "the cat was on the mat")) == pytest.approx(want)


def test_bleu_tokens(spark):
    got = frame(spark, [("Hello, it's 1,000.5 (yes) &quot;no&quot; 3-4.",)], "x string").select(metrics.tokenize_13a(F.col("x")).alias("t")).first().t
    assert got == ["Hello", ",", "it's", "1,000.5", "(", "yes", ")", '"', "no", '"', "3", "-", "4", "."]


def test_chrf(spark):
    of = lambda *rows: metrics.chrf(pairs(spark, *rows), "r", "h").first().chrf
    assert of(("some words here, yes.", "some words here, yes.")) == pytest.approx(100)
    assert of(("aaaa", "bbbb")) == 0
    assert of(("a", "")) == 0
    f = lambda m, h, r: 0 if not m else 5 * (m / h) * (m / r) / (4 * m / h + m / r)
    assert of(("ab cd", "ab ce")) == pytest.approx(100 * (f(3, 4, 4) + f(2, 3, 3) + f(1, 2, 2) + f(0, 1, 1) + f(1, 2, 2) + f(0, 1, 1)) / 6)


def test_clipping(spark):
    got = metrics.ngram_statistics(pairs(spark, ("a a b", "a a a a")), "r", "h", 2).first()
    assert (got.m1, got.h1, got.r1, got.m2) == (2, 4, 3, 1)


def test_greedy_match(spark):
    v = frame(spark, [([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0]])], "a array<array<double>>, b array<array<double>>")
    assert v.select(metrics.greedy_match_f1(F.col("a"), F.col("b")).alias("f")).first().f == pytest.approx(2 / 3)


def test_grid(spark):
    long = frame(spark, [("A", "inga2es", "bleu", 2.0)], "config string, direction string, metric string, value double")
    got = {r.config: r.bleu_inga2es for r in metrics.metrics_grid(long, ["A", "E"], ["bleu"], ["inga2es"]).collect()}
    assert got == {"A": 2.0, "E": 0.0}


def test_vectors(spark, tmp_path):
    records = frame(spark, [(i, f"word{i} text") for i in range(6)], "id long, text string")
    n = vector.build_index(records, "text", adapters.HashEmbedder(32), str(tmp_path / "x"))
    assert n == 6
    with pytest.raises(ValueError, match="records"):
        vector.build_index(records.limit(0), "text", adapters.HashEmbedder(32), str(tmp_path / "y"))
    index = spark.read.parquet(str(tmp_path / "x"))
    asked = adapters.embed(frame(spark, [(9, "word3 text", "inga2es")], "query_id long, text string, direction string"), "text", adapters.HashEmbedder(32)).withColumnRenamed("vector", "query_vector").drop("text")
    got = vector.search(index, asked, 99).orderBy("rank").collect()
    assert len(got) == 6 and got[0].id == 3 and got[0].distance == pytest.approx(0, abs=1e-9)
    bundle = vector.retrieve({"a": index, "b": index.where("id < 2")}, asked.drop("direction"), 3).first()
    assert (len(bundle.a), len(bundle.b), bundle.total) == (3, 2, 5)
    both = index.withColumn("index_name", F.when(F.col("id") < 3, "ejemplos").otherwise("ejemplos_es"))
    routed = vector.retrieve_by_direction(both, asked, {"inga2es": "ejemplos", "es2inga": "ejemplos_es"}, 9).collect()
    assert {r.id for r in routed} == {0, 1, 2}


def test_ties_go_by_key(spark):
    index = frame(spark, [(2, [1.0]), (1, [1.0]), (3, [0.0])], "id long, vector array<float>")
    assert [r.id for r in vector.search_one(index, [1.0], 2).collect()] == [1, 2]


def test_adapters(spark):
    out = adapters.translate(frame(spark, [("a",), (None,)], "p string"), "p", "inga2es", lambda prompts, d: [x.upper() + d for x in prompts]).collect()
    assert [r.hyp for r in out] == ["Ainga2es", "inga2es"]
    with pytest.raises(ValueError, match="direction"):
        adapters.check_direction("x")
    assert adapters.check_direction("es2inga") == ("spa_Latn", "quy_Latn")


def test_retries():
    waits, calls = [], []

    def call(x):
        calls.append(x)
        if len(calls) < 3:
            raise RuntimeError("429 slow down")
        return x

    assert adapters.retried(call, sleep=waits.append)(7) == 7
    assert waits == [5.0, 10.0]
    with pytest.raises(KeyError):
        adapters.retried(lambda: {}["x"], sleep=waits.append)()


def test_translate_with_retrieval(spark):
    embedder = adapters.HashEmbedder(32)
    lexicon = spark.createDataFrame([("wasi", "s", "casa"), ("runa", "s", "gente")], "lema string, cat string, glosa string")
    grammar = spark.createDataFrame([("el sufijo kuna es plural", "G", 0)], "text string, fuente string, chunk_id int")
    examples = spark.createDataFrame([("wasi kuna", "las casas", "Juan", 1, 2), ("runa", "la gente", "Juan", 1, 3)], "texto_inga string, texto_es string, libro string, capitulo long, versiculo long")
    records = vector.index_records(lexicon, grammar, examples)
    assert [r.text for r in records["lexico"].orderBy("lema").collect()] == ["runa (s): gente", "wasi (s): casa"]
    indexes = {k: adapters.embed(df.withColumn("id", F.monotonically_increasing_id()), "text", embedder) for k, df in records.items()}
    seen = lambda prompts, direction: [f" {p} \n" for p in prompts]
    asked = spark.createDataFrame([(1, "wasi kuna"), (2, "runa")], "query_id long, sentence string")
    got = {r.query_id: r.hyp for r in adapters.translate_with_retrieval(asked, "inga2es", indexes, embedder, seen, top_k=1).collect()}
    assert "- INGA: wasi kuna\n  ESPANOL: las casas" in got[1] and "- runa (s): gente" in got[2] and got[1].endswith("wasi kuna")
    plain = adapters.translate_with_retrieval(asked, "es2inga", indexes, embedder, seen, use_context=False).collect()
    assert all("Ejemplos" not in r.hyp for r in plain)


def test_metrics_and_results(spark):
    pairs = spark.createDataFrame([("the cat sat on the mat", "the cat sat on a mat")], "a string, b string")
    r = metrics.all_metrics(pairs, "a", "b", spark.createDataFrame([(0.5,), (0.25,)], "f1 double")).first()
    assert r.bertscore == 0.375 and r.bleu == round(r.bleu, 4) and r.chrf > 50
    got = metrics.results_map(spark.createDataFrame([("A", 1.0, 2.0, 3.0)], "config string, bleu double, chrf double, bertscore double"), ["B", "A"]).collect()
    assert [(x.config, x.metrics and x.metrics.bleu) for x in got] == [("B", None), ("A", 1.0)]


def test_linear_counts(spark):
    """A long text costs no more a character than a short one: 200,000 characters in a row."""
    long = "abcde fghij " * 17_000
    r = metrics.ngram_statistics(spark.createDataFrame([(long, long)], "a string, b string"), "a", "b", 2, "chars").first()
    assert (r.m1, r.m2, r.hyp_len) == (170_000, 169_999, 170_000)


def test_strict_sample(spark):
    with pytest.raises(ValueError):
        align.sample(spark.range(3), "id", 4, strict=True)
    assert align.sample(spark.range(3), "id", 4).count() == 3


def test_null_documents(spark):
    none = spark.createDataFrame([("d", None)], "doc string, value string")
    assert parsing.parse_old_testament(none).count() == parsing.parse_bilingual(none).count() == 0


def test_many_aliases(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    aliases = [(word(rng.randint(3, 9)), i, i) for i in range(10_000)]
    texts = [word(rng.randint(0, 60)) for _ in range(300)] + [None, "", "abcabc", "abcabc"]
    df = frame(spark, list(enumerate(texts)) + [(1, texts[1])], "i int, t string")
    table = spark.createDataFrame(aliases, "alias string, canonical int, place int")
    got = sorted((r.i, r.canonical) for r in align.first_alias(df, "t", table).collect())
    want = [(i, m) for i, t in [*enumerate(texts), (1, texts[1])] if t is not None and (m := min((p for a, p, _ in aliases if a in t), default=None)) is not None]
    assert got == sorted(want) and len(got) > 100
    assert "NestedLoop" not in align.first_alias(df, "t", table)._jdf.queryExecution().executedPlan().toString()
    # An empty alias is in all texts; without aliases there is nothing.
    some = align.first_alias(df, "t", spark.createDataFrame([("zz", 7, 0), ("", 8, 1), ("a", 9, 2)], "alias string, canonical int, place int"))
    assert {r.canonical for r in some.collect()} == {8} and some.count() == len(texts)
    assert align.first_alias(df, "t", table.limit(0)).isEmpty()


def test_aliases_that_can_never_be_first():
    kept = dict(align.undominated([("ring", 0), ("string", 1), ("in", 2), ("on", 3), ("on", 5), ("only", 2)]))
    assert kept == {"ring": 0, "in": 2, "on": 3, "only": 2}


def test_keep_first_with_a_map(spark):
    df = spark.sql("SELECT 1 AS k, 2 AS o, map('a', 1) AS m UNION ALL SELECT 1, 1, map('b', 2)")
    assert [r.m for r in align.keep_first(df, ["k"], ["o"]).collect()] == [{"b": 2}]


@pytest.mark.parametrize("held", [0, 1 << 23])
@pytest.mark.parametrize("idf", [False, True])
def test_match_scores(spark, idf, held):
    rng = np.random.default_rng(2)
    names = [f"w{i}" for i in range(12)]
    vectors = {w: rng.normal(size=5) for w in names[:10]}
    pairs = [(" ".join(rng.choice(names, rng.integers(0, 9))), " ".join(rng.choice(names, rng.integers(0, 9)))) for _ in range(30)] + [(None, "w1"), ("w10 w11", "w1"), ("w1", "w1")]
    refs = [(r or "").split() for r, _ in pairs]
    weight = lambda w: math.log((len(refs) + 1) / (sum(w in r for r in refs) + 1)) if idf else 1.0
    cosine = lambda a, b: float(vectors[a] @ vectors[b] / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b]))

    def side(xs, ys):
        return sum(weight(x) * max(cosine(x, y) for y in ys) for x in xs) / sum(map(weight, xs))

    want = []
    for r, h in pairs:
        a, b = ([w for w in (t or "").split() if w in vectors] for t in (r, h))
        rec, pre = (side(a, b), side(b, a)) if a and b else (0, 0)
        want.append(2 * rec * pre / (rec + pre) if rec + pre else 0.0)
    table = spark.createDataFrame([(w, v.tolist()) for w, v in vectors.items()], "token string, vector array<double>")
    got = metrics.match_scores(frame(spark, pairs, "r string, h string"), "r", "h", table, idf, block=2, held_numbers=held)
    assert sorted(x.f1 for x in got.collect()) == pytest.approx(sorted(want), abs=1e-9)


def test_answers_are_asked_once(spark, tmp_path):
    calls, fails = tmp_path / "calls", tmp_path / "fails"
    calls.mkdir()

    def model(prompts, direction):
        for p in prompts:
            if p == "bad" and fails.exists():
                raise RuntimeError("no answer")
            (calls / f"{p}-{uuid.uuid4().hex}").touch()
        return [f"{p}!" for p in prompts]

    asked = frame(spark, [(i, ["a", "b", "bad", None][i % 4]) for i in range(40)], "k int, p string").repartition(4)
    fails.touch()
    of = lambda: {(r.p, r.hyp) for r in adapters.answered(asked, "p", "inga2es", model, str(tmp_path / "store"), batch=1).collect()}
    assert of() == {("a", "a!"), ("b", "b!"), ("bad", None), (None, "!")}
    fails.unlink()
    assert of() == {("a", "a!"), ("b", "b!"), ("bad", "bad!"), (None, "!")}
    of()
    assert sorted(x.name.split("-")[0] for x in calls.iterdir()) == ["", "a", "b", "bad"]
    drafts = frame(spark, [("q", "d"), ("q", None)], "p string, draft string")
    got = {(r.draft, r.refined) for r in adapters.refine(drafts, "p", "draft", "inga2es", model, str(tmp_path / "other")).collect()}
    assert got == {("d", "q\n\nTraduccion automatica preliminar a refinar:\nd\n\nVersino refinada:!"), (None, None)}


def test_gram_counts():
    rng = random.Random(9)
    for _ in range(300):
        r, h = ([rng.randint(0, 3) for _ in range(rng.randint(0, 12))] for _ in range(2))
        want = []
        for n in range(1, 5):
            a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (r, h))
            want += [sum((a & b).values()), sum(b.values()), sum(a.values())]
        assert metrics.gram_counts(np.array(r, np.int64), np.array(h, np.int64), 4) == want
