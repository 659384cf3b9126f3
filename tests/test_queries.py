"""Every query against its SQL on the smallest tables."""

import pytest

from helixframe import registry
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    compare(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF)


def test_entry_points_import_and_agree():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
