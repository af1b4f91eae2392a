from __future__ import annotations

import oracle
import pytest

from terracell import queries

Q, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(Q))
def test_matches_sql(spark, name):
    assert name in SQL
    oracle.check(spark, Q[name], SQL[name])


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
