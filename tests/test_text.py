import pytest
from pyspark.sql import functions as F

from corpusloom.functions import tables, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value", ["", " ", "a", "  a  b ", "a b\tc d", "\n\nx\x0by", "é ü"])
def test_words_and_strip_follow_python(spark, value):
    assert one(spark, value, text.words) == value.split()
    assert one(spark, value, text.strip) == value.strip()
    assert one(spark, value, text.rstrip) == value.rstrip()
    assert one(spark, value, text.collapse) == " ".join(value.split())


@pytest.mark.parametrize("value", ["", "a", "a\n", "a\r\nb\rc\n\nd", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "\n"])
def test_lines_follow_python(spark, value):
    assert one(spark, value, text.lines) == value.splitlines()


def test_superscripts(spark):
    assert one(spark, "¹²-³", text.superscript_digits) == "12-3"


def test_tokens(spark):
    assert one(spark, "¿Qué, (tal)? \"...\" Bien!", lambda x: text.tokens(x, tables.SCORE_MARKS)) == ["qué", "tal", "bien"]


def test_fixed_tables():
    assert len(tables.NT_ALIASES) == len(tables.NT_CANON) == len(tables.NT_CODES) == 27
    assert sum(tables.NT_CANON.values()) == 7958
    assert len(tables.OT_CODES) == 39 and len(tables.OT_ALIASES) == 38
    assert set(tables.NT_ALIASES.values()) == set(tables.NT_CANON)
