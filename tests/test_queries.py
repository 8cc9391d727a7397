"""Every registered query of the library against its DuckDB SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from ledgerwing.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return f"{round(float(v), 6):g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    got = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(got.columns)
    assert plain(rows, df.columns) == plain(got.fetchall(), got.columns)
