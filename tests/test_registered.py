"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import math
import os
from collections import Counter
from pathlib import Path

import pytest

from folioflow import catalog

DIR = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DIR.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, str(DIR))
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()) if name in catalog.oracle_sql() else df.count()
    if name not in catalog.oracle_sql():
        return
    rows = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == sorted(df.columns)
    assert got == Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rows.fetchall())
