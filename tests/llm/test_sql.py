"""The queries that have SQL against DuckDB, on the session's documents."""

import duckdb
import pytest

from lodestone.llm import queries as Q


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet/*.parquet'")
    df, found = Q.queries()[name](spark, sf_dir), con.sql(Q.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got and got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
