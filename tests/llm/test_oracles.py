"""Each corpus query that has SQL against it, by values."""

import duckdb
import pytest

from sievework.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "conversations", "benchmark", "labels"]
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SQL)
def test_query_matches_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    row = lambda values: tuple(round(v, 9) if isinstance(v, float) else v for v in values)
    want = sorted((row(r[names.index(n)] for n in order) for r in want.fetchall()), key=str)
    assert sorted((row(r[n] for n in order) for r in got.collect()), key=str) == want
