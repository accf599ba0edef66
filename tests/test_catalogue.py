"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from sievework.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations"
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[k]) for k in cols]) for r in df.collect())
    if name not in catalogue.oracle_sql():
        assert got
        return
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(k) for k in cols]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_entry(spark):
    rows = catalogue.entry(spark, SF).collect()
    cells = {}
    for r in rows:
        cells[r["lang"], r["quality"]] = cells.get((r["lang"], r["quality"]), 0) + r["n"]
    assert rows and len(set(cells.values())) == 1
