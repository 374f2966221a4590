"""Every core query against its SQL on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from claimlens import catalog

TABLES = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(f"{float(v):.9g}") if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(TABLES):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for path in glob.glob(TABLES + "/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_parity(spark, duck, name):
    mine = catalog.queries()[name](spark, TABLES)
    theirs = duck.sql(catalog.oracle_sql()[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    columns = sorted(mine.columns)
    a = Counter(tuple(plain(r[c]) for c in columns) for r in mine.collect())
    at = [theirs.columns.index(c) for c in columns]
    b = Counter(tuple(plain(r[i]) for i in at) for r in theirs.fetchall())
    assert a == b


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert catalog.FLAGSHIP in catalog.queries()
