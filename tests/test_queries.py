"""Every query of the library against its SQL in DuckDB."""

import pytest

from lattica.plans import registry
from tests.oracle import duck, duck_rows, rows_of

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(DIR)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DIR)
    names, rows = rows_of(df)
    if (text := registry.oracle_sql().get(name)) is None:
        assert names
        return
    other_names, other = duck_rows(con, text)
    assert names == other_names
    assert rows == other


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
