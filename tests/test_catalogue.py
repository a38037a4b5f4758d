import duckdb
import pytest

from corpusloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(pdf):
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object)
    return sorted(map(tuple, pdf.where(pdf.notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(catalogue.ORACLE))
def test_equals_sql(spark, sql, name):
    got = rows(catalogue.QUERIES[name](spark, SF).toPandas())
    assert got == rows(sql.sql(catalogue.ORACLE[name]).df())
    assert got
