"""Queries with SQL give the rows that DuckDB gives."""

import os

import duckdb
import pytest

from textloom.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_agree(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in out.collect()), key=repr) == want


def test_every_query_takes_paths_that_only_spark_reads():
    import inspect

    from textloom.llm import queries

    assert "open(" not in inspect.getsource(queries)
