"""Every query of the catalogue against its SQL on the smallest tables; without SQL, that it runs and has rows."""

import math
import os

import duckdb
import pytest

from triagelake import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is not None, str(type(v)) if not isinstance(v, int | float) else "", v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = catalog.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in found.collect()]
    if name not in catalog.oracle_sql():
        assert rows
        return
    result = duck.sql(catalog.oracle_sql()[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert ordered(rows) == ordered([tuple(plain(r[i]) for i in at) for r in result.fetchall()])
