"""Every registered query with SQL gives the rows that DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest

from augury.plans.registry import QUERIES, SQL

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(v, 5) + 0.0 if isinstance(v, float) else v if isinstance(v, (bool, int)) else str(v)

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    ours = QUERIES[name](spark, D)
    cols = sorted(ours.columns)
    theirs = duck.execute(SQL[name])
    names = [c[0] for c in theirs.description]
    assert sorted(names) == cols
    assert plain(tuple(r) for r in ours.select(*cols).collect()) == plain(tuple(r[names.index(c)] for c in cols) for r in theirs.fetchall())
