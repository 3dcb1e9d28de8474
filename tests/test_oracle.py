"""Every SQL-checked query against its DuckDB text, on the sf0.001 tables.

The same comparison the driver makes at sf0.01 (tools/check_oracle.py):
row count, column names and types, and an order-insensitive value hash.
"""

import importlib.util
import os

import duckdb
import pytest

from conftest import SF_SMOKE
from demandcast.plans.registry import SQL_CHECKED

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _load(path, name):
    spec = importlib.util.spec_from_file_location(name, os.path.join(ROOT, path))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


CHECK = _load("tools/check_oracle.py", "check_oracle")
ENTRY = _load("__spark_entry__.py", "spark_entry")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in CHECK.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMOKE}/{t}.parquet')")
    yield con
    con.close()


def test_every_sql_query_has_an_oracle():
    assert set(SQL_CHECKED) <= set(ENTRY.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL_CHECKED))
def test_query_matches_oracle(spark, duck, name):
    df = ENTRY.queries()[name](spark, SF_SMOKE)
    srows = [tuple(r) for r in df.collect()]
    sql = ENTRY.oracle_sql()[name]
    res = duck.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    dtypes = duck.execute(f"DESCRIBE ({sql})").fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert CHECK.type_mismatches(df.dtypes, [(r[0], r[1]) for r in dtypes]) == []
    assert len(srows) == len(drows)
    assert CHECK.digest(df.columns, srows) == CHECK.digest(dcols, drows)
