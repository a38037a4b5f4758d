"""Order statistics by counts, and tables side by side by position."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import align
from corpusloom.sources import readers, writers


def key_of(x):
    return "" if x is None else hashlib.md5(f"42:{x}".encode()).hexdigest()


@pytest.mark.parametrize(("few", "digits"), [(1000, 4), (3, 1), (0, 2)])
def test_cut_values(spark, monkeypatch, few, digits):
    monkeypatch.setattr(align, "FEW", few)
    monkeypatch.setattr(align, "DIGITS", digits)
    rng = random.Random(1)
    values = [rng.choice(["", "abcd", "abce", f"{rng.randrange(65536):04x}"]) for _ in range(700)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    values.sort()
    ranks = [0, 1, 20, 350, 351, 699, 700, 5000]
    want = {r: (values[r], values.index(values[r]), values.count(values[r])) for r in ranks if r < 700}
    assert align.cut_values(df, "v", ranks) == want
    assert align.cut_values(df.limit(0), "v", [0]) == {}


def test_split_is_by_place(spark):
    n = 3000
    want = {k: "train" if i < 2400 else "val" if i < 2700 else "test" for i, k in enumerate(sorted(range(n), key=key_of))}
    got = align.split(spark.range(n).select("id", F.lit(1).alias("split_of")).repartition(7), "id")
    assert {r.id: r.split for r in got.collect()} == want
    assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot", [None, 5])
def test_hot_key_is_cut_exactly(spark, hot):
    """Seven rows of ten repeat one key, which lies over both cuts or before them; sizes are exact all the same."""
    keys = [hot] * 700 + list(range(100, 400))
    df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(5)
    got = align.split(df, "k", shares=(30, 30))
    assert got.columns == ["k", "split"]
    rows = [(r.k, r.split) for r in got.collect()]
    assert sorted((r[0] is None, r[0] or 0) for r in rows) == sorted((k is None, k or 0) for k in keys)
    turn = {"train": 0, "val": 1, "test": 2}
    by_place = sorted(rows, key=lambda r: (key_of(r[0]), turn[r[1]]))
    assert [r[1] for r in by_place] == ["train"] * 300 + ["val"] * 300 + ["test"] * 400
    assert align.sample(df, "k", 450).count() == 450


def test_attach(spark):
    left = spark.range(500).select((F.col("id") * 7 % 500).alias("a")).repartition(6)
    right = spark.range(500).select((499 - F.col("id")).alias("b"), F.lit("x").alias("c")).repartition(3)
    got = align.attach(left, right, ["a"], ["b"])
    assert sorted((r.idx, r.a, r.b) for r in got.collect()) == [(i, i, i) for i in range(500)]
    with pytest.raises(align.UnequalLengths) as e:
        align.attach(left, right.where("b > 0"), ["a"], ["b"])
    assert (e.value.left, e.value.right) == (500, 499) and isinstance(e.value, ValueError)
    with pytest.raises(ValueError, match="both sides: a"):
        align.attach(left, right.withColumnRenamed("b", "a"), ["a"], ["a"])
    assert align.attach(left.limit(0), right.limit(0), ["a"], ["b"]).count() == 0


def test_one_file_in_order(spark, tmp_path):
    """More than eleven parts, so that their names' order counts, twice over the same path; some parts are empty."""
    path = str(tmp_path / "out.jsonl")
    df = spark.range(4000).select(F.col("id").alias("k"), F.repeat(F.lit("ñ"), (F.col("id") % 50).cast("int")).alias("t"))
    for least in (0, 3500, 9000):
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        try:
            writers.json_lines(df.where(F.col("k") >= least).repartition(5), path, ["k"], one_file=True)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        with open(path, encoding="utf-8") as f:
            lines = [json.loads(x) for x in f]
        assert lines == [{"k": k, "t": "ñ" * (k % 50)} for k in range(least, 4000)]
        assert spark.read.text(path).count() == len(lines)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out.jsonl"]


def test_streamed_copy(spark, tmp_path):
    """What a file system without joining of files gets."""
    parts = str(tmp_path / "parts")
    spark.range(100).repartitionByRange(12, "id").write.json(parts)
    fs, at = writers._fs(spark, parts)
    writers._streamed(spark, fs, [p for p, _ in writers._parts(fs, at)], writers._fs(spark, str(tmp_path / "one"))[1])
    assert (tmp_path / "one").read_text() == "".join(f'{{"id":{i}}}\n' for i in range(100))


def test_backup_leaves_the_file(spark, tmp_path):
    path = str(tmp_path / "a.json")
    assert writers.backup(spark, path, "v1") is None
    writers.json_object(spark, path, {"a": 1})
    kept = writers.backup(spark, path, "v1")
    assert kept == f"{path}.v1" and writers.read_object(spark, kept) == writers.read_object(spark, path) == {"a": 1}


def test_places_over_blocks(spark, tmp_path):
    """A file that is read in several blocks, dealt to tasks in any order."""
    path = str(tmp_path / "one.jsonl")
    writers.json_lines(spark.range(5000).select((F.col("id") * 3).alias("k"), F.lit("y" * 30).alias("t")), path, ["k"], one_file=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = readers.numbered_json_lines(spark, path, "k long, t string")
        assert found.rdd.getNumPartitions() > 5
        assert {(r.place, r.k) for r in found.collect()} == {(i, 3 * i) for i in range(5000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
