"""Every registered query of the library against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb
import pytest

from strandline.plans import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(tuple(map(plain, r)) for r in got.select(*columns).collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert sorted(tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()) == rows


@pytest.mark.parametrize("name", ["q_even_thinning", "q_nearest_each_side", "q_quote_verbatim", "q_truth_match_closest"])
def test_whole_tables(name):
    """Each reference query over a subset has a twin without it, which test_query compares with DuckDB."""
    cut, whole = ORACLE_SQL[name], ORACLE_SQL[f"{name}_whole"]
    assert f"{name}_whole" in QUERIES and len(whole) < len(cut)
    assert not any(x in whole for x in ("supp < 8", "% 7 = 0", "% 5 = 0", "substr("))
