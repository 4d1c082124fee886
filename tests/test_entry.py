"""The driver contract, and every core query with SQL gives that SQL's rows."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import SF, difference

CORE = {name: sql for m in entry.MODULES if not m.__name__.startswith("exonia.llm") for name, sql in m.ORACLE.items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", CORE)
def test_rows_are_those_of_the_sql(spark, name):
    assert difference(entry.queries()[name](spark, SF), CORE[name]) == ([], [])
