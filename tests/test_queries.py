"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from setflow.plans import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows(frame):
    return sorted(map(repr, frame[sorted(frame.columns)].astype(object).values.tolist()))


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query(spark, con, name):
    got = q.QUERIES[name](spark, SF).toPandas()
    if name in q.ORACLE_SQL:
        want = con.execute(q.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
