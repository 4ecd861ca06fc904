"""Every registered query of the reference part runs and gives the rows of its SQL on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from recordsmith.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def plain(v):
    """A value in one form for both engines."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return bytes(v) if isinstance(v, bytearray) else v


def table(names, rows):
    order = sorted(names)
    return sorted(([plain(row[names.index(n)]) for n in order] for row in rows), key=repr)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-4)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    mine = table(got.columns, got.collect())
    if name not in ORACLE:
        return
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    theirs = table(want.columns, want.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert all(map(same, a, b)), (a, b)
