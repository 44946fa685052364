"""Every registered query of the sheet's operators, against its SQL on the small tables."""

import pytest

from fieldleaf.plans.sql import SQL
from fieldleaf.queries import QUERIES
from tests.against import assert_same, connect


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_same_as_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), connect(sf), SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
