"""Every query of the training-data operators that has SQL gives that SQL's rows."""

import pytest

from copperleaf.llm import registry
from tests.oracle import differences

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.01") == ""
