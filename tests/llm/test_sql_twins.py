import duckdb
import pytest

from kinmap.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
