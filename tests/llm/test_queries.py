"""Every query of the subpackage with SQL gives that SQL's rows."""

import os

import pytest

from exonia.llm import queries
from tests.oracle import SF, difference


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", queries.ORACLE)
def test_rows_are_those_of_the_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), queries.ORACLE[name]) == ([], [])
