"""Every core query that has an oracle gives the oracle's rows on the smallest tables."""

import pytest

from lodeworks.plans import registry
from tests.oracle import connect, oracle_rows, spark_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    columns, expected = oracle_rows(con, registry.oracle_sql()[name])
    assert sorted(df.columns) == columns
    assert spark_rows(df) == expected


def test_every_query_is_callable_and_entry_gives_rows(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
