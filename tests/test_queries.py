"""Every query of the catalogue that has SQL, against DuckDB on the smallest tables; every other one runs."""

import datetime
import decimal
import os

import duckdb
import pytest

from corpuslake.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return repr(round(float(x), 6) + 0.0)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name in ORACLES:
        assert rows(got) == rows(con.sql(ORACLES[name]).to_arrow_table())
