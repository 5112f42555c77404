"""The numbered queries that SQL can state, against DuckDB."""

import pytest

from loomlog.llm import oracle as sql
from loomlog.llm import queries
from tests import oracle

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_matches_sql(spark, name):
    names, want = oracle.rows_of_sql(oracle.connection(SF), sql.ORACLE_SQL[name])
    got_names, got = oracle.rows_of_spark(queries.QUERIES[name](spark, SF))
    assert got_names == names
    assert len(got) == len(want) > 0
    assert got == want
