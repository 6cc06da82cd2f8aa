"""Every registered query against DuckDB on the smallest driver tables."""

import os

import pytest

from storygraph.plans.catalogue import REGISTRY
from storygraph.plans.oracle import ORACLE

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(rows):
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows], key=lambda r: [(v is None, str(v)) for v in r])


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(REGISTRY)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, duck, name):
    df = REGISTRY[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    result = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})")
    assert plain(got) == plain(result.fetchall())
