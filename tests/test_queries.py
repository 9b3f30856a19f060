"""Each query and golden case with SQL gives the same rows as DuckDB; the others give rows."""

import glob
import os

import duckdb
import pytest

from inkspark.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


CASES = {n: (f, catalog.ORACLE_SQL.get(n)) for n, f in catalog.QUERIES.items()} | catalog.GOLDEN


@pytest.mark.parametrize("name", list(CASES))
def test_same_rows_as_sql(spark, duck, name):
    run, sql = CASES[name]
    df = run(spark, DATA)
    rows = df.collect()
    if sql is not None:
        found = duck.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert plain(rows, df.columns) == plain(found.fetchall(), columns)
    else:
        assert rows
