"""Every registered query runs, and equals its SQL where it has some."""

import glob
import math
import os

import duckdb
import pytest

from lectern import plans


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(x, 9) if isinstance(x, float) and not math.isnan(x) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, small, duck, name):
    df = plans.QUERIES[name](spark, small)
    rows = df.collect()
    if name not in plans.SQL:
        assert rows
    else:
        want = duck.execute(plans.SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert canonical(rows, df.columns) == canonical(want.fetchall(), columns)
