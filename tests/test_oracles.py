"""Every query over the reference's operators that has SQL gives that SQL's rows."""

import pytest

from copperleaf.plans import ORACLES, QUERIES
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001") == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0
