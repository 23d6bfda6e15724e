"""Every registered query of the core against its SQL."""

import duckdb
import pytest

from minutario.plans import registry
from tests_compare import compare

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    df = QUERIES[name](spark, folder)
    if name in SQL:
        compare(df, SQL[name], folder, duckdb)
    else:
        assert df.count() >= 0


def test_entry_points_agree(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert __spark_entry__.entry(spark).columns
