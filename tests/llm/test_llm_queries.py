"""Every query with SQL gives the SQL's rows over whole tables."""

import duckdb
import pytest

from minutario.llm.queries import QUERIES
from minutario.llm.sql import ORACLE_SQL
from tests_compare import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    df = QUERIES[name](spark, folder)
    if name in ORACLE_SQL:
        compare(df, ORACLE_SQL[name], folder, duckdb)
    else:
        assert df.count() > 0
