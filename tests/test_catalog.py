"""Every registered graph query against its SQL."""

import os

import duckdb
import pytest

from graphloom import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(rows):
    return sorted(tuple("~" if v is None else repr(round(float(v), 6)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = [tuple(r[names.index(c)] for c in columns) for r in want.fetchall()]
    assert shown(got.select(columns).collect()) == shown(rows)


def test_flagship_reads_only_its_columns(spark):
    plan = catalog.flagship(spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice" in plan
    assert "c_acctbal" not in plan.split("== Physical Plan ==")[1]
