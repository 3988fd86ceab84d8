"""Every query that SQL expresses, against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from proofmill.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if hasattr(x, "as_tuple"):
        x = float(x)
    return f"{x:.9g}" if isinstance(x, float) and not math.isnan(x) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_duckdb(spark, duck, name):
    mine = QUERIES[name](spark, SF)
    other = duck.execute(ORACLE[name])
    names = [d[0] for d in other.description]
    assert sorted(mine.columns) == sorted(names)
    want = sorted(tuple(plain(x) for x in r) for r in other.fetchall())
    assert sorted(tuple(plain(x) for x in r) for r in mine.select(*names).collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
