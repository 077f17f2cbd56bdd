"""Every query with an SQL twin agrees with it."""

import pytest
from conftest import SMALL

from codeweft.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(name, spark, duck, same):
    same(QUERIES[name](spark, SMALL), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_twin(name, spark):
    """Rows come, and the same ones again."""
    first, again = (sorted(map(str, QUERIES[name](spark, SMALL).collect())) for _ in range(2))
    assert first and first == again


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
