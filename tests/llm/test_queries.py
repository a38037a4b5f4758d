"""The queries that have SQL, against it."""

import duckdb
import pytest

from corpusloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_equals_sql(spark, name):
    sql = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        sql.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = sql.sql(queries.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    value = lambda rows: sorted((tuple(r[c] for c in columns) for r in rows), key=repr)
    assert value(r.asDict() for r in got.collect()) == value(dict(zip(want.columns, r, strict=True)) for r in want.fetchall())
