"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as entry
from oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sql = entry.oracle_sql().get(name)
    r = compare(spark, con, SF, name, entry.queries()[name], sql)
    assert r["status"] in ("ok", "rows-only"), r["status"]
    assert "types" not in r, r.get("types")


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "category" in df.columns
