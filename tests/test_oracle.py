"""Every registered query with SQL against DuckDB."""

import pytest

import __spark_entry__ as entry
from tests import oracle

SF = "/root/testdata/sf0.01"
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith(("op", "pipeline"))}


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    names, want = oracle.rows_of_sql(con, SQL[name])
    got_names, got = oracle.rows_of_spark(entry.queries()[name](spark, SF))
    assert got_names == names
    assert len(got) == len(want) > 0
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_rows_only(spark):
    assert entry.queries()["audit_brief"](spark, SF).where("length(brief) > 0").count() > 0
