"""Each query that SQL can express gives the rows of its SQL."""

import pytest

import __spark_entry__ as entry
from tests.oracle import of_spark, of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert of_spark(entry.queries()[name](spark, SF)) == of_sql(entry.oracle_sql()[name], SF)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
