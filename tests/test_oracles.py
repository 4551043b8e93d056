"""Every query with a DuckDB twin, on the smallest data, row by row."""

import glob
import math
import os

import duckdb
import pytest

from candlery.plans import candle_queries, data_queries, market_queries, model_queries, relation_queries, report_queries, store_queries, summary_queries, trend_queries

FOLDER = "/root/testdata/sf0.001"
MODULES = (data_queries, candle_queries, market_queries, model_queries, relation_queries, report_queries, store_queries, summary_queries, trend_queries)
TWINS = {name: (module, sql) for module in MODULES for name, sql in module.oracle_sql().items()}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")
@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, name):
    module, sql = TWINS[name]
    found = module.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    mine = sorted(tuple(map(plain, r)) for r in found.select(*columns).collect())
    cursor = duck.execute(f"select {', '.join(columns)} from ({sql})")
    assert mine == sorted(tuple(map(plain, r)) for r in cursor.fetchall())


def test_names_do_not_clash():
    names = [n for m in MODULES for n in m.queries()]
    assert len(names) == len(set(names)) and set(TWINS) <= set(names)
