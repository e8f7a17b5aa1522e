"""Every named query against its SQL twin on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from foliant.plans import catalogue

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    twin = db.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in twin.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in twin.fetchall()), key=repr)
    assert len(rows) == len(want)
    assert rows == want
