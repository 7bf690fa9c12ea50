"""Every reference query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from vellumlake.plans.catalog import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def rows(pdf, columns):
    plain = lambda x: "" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(plain, r)) for r in pdf[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


def test_memory_queries_take_every_row(spark, db):
    rows, sections, edited = db.sql("select count(*), count(distinct (role, conv_id)), count(*) filter (turn = 1) from conversations").fetchall()[0]
    assert QUERIES["q21_memory_section_text"](spark, SF).count() == sections
    n = {}
    for r in QUERIES["q25_reconcile_all_entries"](spark, SF).collect():
        n[r.action] = n.get(r.action, 0) + r.n
    assert edited and n["keep"] + n["delete"] == n["keep"] + n["insert"] == rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
