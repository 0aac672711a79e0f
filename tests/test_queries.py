"""Every registered query of the dialect against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quarrysql.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(x):
    return round(float(x), 6) if isinstance(x, float) else x


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    db.execute(SQL[name])
    names = [c[0] for c in db.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in db.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
