"""Every registered query against its SQL twin on DuckDB, value by value."""

import duckdb
import pytest

from strandmill.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, tiny, duck, name):
    mine = catalog.queries()[name](spark, tiny)
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(mine.columns)
    theirs = sorted((tuple(plain(v) for v in row) for row in cursor.fetchall()), key=repr)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in mine.collect()), key=repr)
    assert len(ours) == len(theirs)
    assert ours == theirs


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
