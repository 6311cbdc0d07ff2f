"""The driver contract, and every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(x):
    return round(x, 6) if isinstance(x, float) else tuple(map(plain, x)) if isinstance(x, list) else float(x) if type(x).__name__ == "Decimal" else x


def table(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "chunk_id", "source", "score"] and entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    out = db.sql(catalog.ORACLES[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(out.columns, out.fetchall())
