"""Every query with SQL gives the rows that DuckDB gives at sf0.001."""

import os

import duckdb
import pytest

from quillon.plans.oracles import ORACLES
from quillon.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows):
    return sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    if name in ORACLES:
        own = duck.sql(ORACLES[name])
        assert sorted(own.columns) == columns
        assert got == plain(own.select(*[f'"{c}"' for c in columns]).fetchall())
    else:
        assert got
