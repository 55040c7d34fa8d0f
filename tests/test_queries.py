"""Every registered query of the library against its SQL twin."""

import pytest
from oracle import SF, rows_of, sql_rows

from windowforge.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    cols, rows = rows_of(registry.QUERIES[name](spark, SF))
    if name in registry.ORACLE:
        assert (cols, rows) == sql_rows(registry.ORACLE[name])
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "status" in e.entry(spark).columns
