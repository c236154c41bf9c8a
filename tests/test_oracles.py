"""Every registered query with SQL gives the rows that DuckDB gives."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from textloom import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)) and not isinstance(b, bool):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return type(a) is type(b) and a == b or isinstance(a, int) and isinstance(b, float) and float(a) == b


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_and_sql_agree(spark, duck, name):
    out = plans.QUERIES[name](spark, SF)
    got = rows(out.columns, [tuple(r) for r in out.collect()])
    result = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in result.description]
    want = rows(names, result.fetchall())
    assert sorted(out.columns) == sorted(names)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(same(x, y) for x, y in zip(g, w, strict=True)), (g, w)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
