"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import connect, difference

from __spark_entry__ import entry, oracle_sql, queries

SQLS = oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf, con, name):
    df = queries()[name](spark, sf)
    if name in SQLS:
        assert difference(df, con, SQLS[name]) is None
    else:
        assert df.count() >= 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(SQLS) <= set(queries())
