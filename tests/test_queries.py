"""Every registered query against its SQL in DuckDB, and the shape of plans."""

from __future__ import annotations

import math
import re

import duckdb
import pytest

from quarry import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con(testdata):
    c = duckdb.connect()
    for p in sorted((testdata / "sf0.001").glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_match_sql(spark, testdata, con, name):
    df = QUERIES[name](spark, str(testdata / "sf0.001"))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_find_models_stays_in_the_engine(spark, testdata):
    plan = executed(QUERIES["find_models"](spark, str(testdata / "sf0.001")))
    assert "WindowGroupLimit" in plan and "TakeOrderedAndProject" in plan
    assert not re.search("Python|CartesianProduct", plan)


def test_scans_read_only_what_queries_need(spark, testdata):
    plan = executed(QUERIES["status_counts"](spark, str(testdata / "sf0.001")))
    assert re.search(r"ReadSchema: struct<o_orderstatus:string>", plan)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,P\)", executed(QUERIES["semi_join_families"](spark, str(testdata / "sf0.001"))))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
