"""Every registered query of the library gives the rows of its SQL twin."""

import os

import duckdb
import pytest

from oracle_check import rows_of
from spanlake import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    mine = plans.QUERIES[name](spark, SF).toPandas()
    assert len(mine) > 0 and len(set(mine.columns)) == len(mine.columns)
    if name in plans.ORACLE:
        other = db.execute(plans.ORACLE[name]).df()
        assert sorted(mine.columns) == sorted(other.columns)
        assert rows_of(mine) == rows_of(other)
