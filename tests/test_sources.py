import pytest

from corpusloom.operators import parsing
from corpusloom.sources import readers, writers
from corpusloom.streaming import ingest


def test_whole_files_and_catalogue(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("á\nb")
    (tmp_path / "b.txt").write_text("c")
    (tmp_path / "sub/c.md").write_text("d")
    got = readers.whole_files(spark, str(tmp_path), "*.md").collect()
    assert [(r.file_name, r.value) for r in got] == [("a.md", "á\nb")]
    assert readers.first_existing(spark, str(tmp_path / "no"), str(tmp_path / "a.md")).endswith("a.md")
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, str(tmp_path / "no"))
    assert [r.present for r in readers.catalogue(spark, {"a": str(tmp_path / "a.md"), "n": str(tmp_path / "n")}).collect()] == [True, False]


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "x")
    writers.json_lines(spark.createDataFrame([(2, "ñ"), (1, None)], "idx int, t string"), path, ["idx"], one_file=True)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == ['{"idx":1,"t":null}', '{"idx":2,"t":"ñ"}']
    assert readers.json_lines(spark, path, "idx int, t string").count() == 2
    assert readers.optional(spark, str(tmp_path / "none"), "a int") is None
    df = spark.createDataFrame([(1,)], "a int")
    assert df.select(readers.column_or_null(df, "b", "double")).first().b is None


def test_objects(spark, tmp_path):
    path = str(tmp_path / "o.json")
    assert writers.read_object(spark, path) == {}
    assert readers.json_object(spark, path, "a int").first().a is None
    assert writers.upsert_object(spark, path, {"a": 1, "b": "ñ"}) == {"a": 1, "b": "ñ"}
    assert writers.upsert_object(spark, path, {"a": 2}) == {"a": 2, "b": "ñ"}
    assert readers.json_object(spark, path, "a int, b string").first().a == 2
    moved = writers.keep_version(spark, path, "v1")
    assert moved and not readers.exists(spark, path) and writers.keep_version(spark, path, "v2") is None


def test_tables(spark, tmp_path):
    path = str(tmp_path / "idx/one")
    writers.upsert_table(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    writers.upsert_table(spark.createDataFrame([(2, "c")], "k int, v string"), path, ["k"])
    assert sorted(tuple(r) for r in readers.vector_table(spark, path).collect()) == [(1, "a"), (2, "c")]
    assert readers.vector_tables(spark, str(tmp_path / "idx")) == ["one"]
    assert readers.vector_tables(spark, str(tmp_path / "none")) == []


def test_stream(spark, tmp_path):
    folder, table, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one\n\ntwo")
    for n in (1, 2):
        ingest.ingest(ingest.stream_files(spark, folder), parsing.paragraphs, table, state).awaitTermination()
        (tmp_path / "in/b.txt").write_text("three")
        assert spark.read.parquet(table).count() == n + 1
