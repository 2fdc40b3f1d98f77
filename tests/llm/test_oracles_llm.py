"""Queries of the training-data operators against their DuckDB SQL, and the
inputs every operator must stand: nulls, empty texts and tables, repeated rows,
ties, long texts, extra columns."""

import pytest

from oracle_harness import compare, duck
from stockfair.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, con, name):
    r = compare(spark, con, SF, name, queries.QUERIES[name], queries.SQL[name])
    assert r["status"] == "ok", r["status"]
    assert "types" not in r, r.get("types")
