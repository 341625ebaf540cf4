"""Every registered query against its DuckDB SQL twin on the smallest tables."""

import os
import sys

import pytest

import __spark_entry__ as E
from ledgerlens.plans.oracle_queries import ORACLE
from ledgerlens.plans.queries import QUERIES
from tests.conftest import SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
duckdb = pytest.importorskip("duckdb")
import oracle_check as oc  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in oc.TABLES:
        p = os.path.join(SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, con, name):
    sdf = QUERIES[name](spark, SMALL)
    a, an = oc.rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    cur = con.execute(ORACLE[name])
    b, bn = oc.rows_of([d[0] for d in cur.description], cur.fetchall())
    assert an == bn
    assert len(a) == len(b)
    a.sort(key=oc.key)
    b.sort(key=oc.key)
    for r, s in zip(a, b):
        assert all(oc.close(x, y) for x, y in zip(r, s)), (r, s)


def test_rows_only_queries_run(spark):
    for name in set(QUERIES) - set(ORACLE):
        assert QUERIES[name](spark, SMALL).count() >= 1


def test_registry_holds_every_query():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["month", "revenue", "ma3"] and df.count() > 0
