"""Every registered query with SQL agrees with DuckDB; the others give rows."""

import pytest

from strandweave.plans import coded  # noqa: F401 - registers its queries
from strandweave.plans.catalog import ORACLE, QUERIES
from tests.harness import DATA, compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE:
        assert compare(spark, QUERIES[name], ORACLE[name]) >= 1
    else:
        assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["depth", "entity"] and set(e.oracle_sql()) <= set(e.queries())
