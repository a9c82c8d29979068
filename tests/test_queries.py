"""Every registered query against its SQL on the smallest tables."""

import pytest

from oracle_check import compare, duck
from pageloom.plans import catalog


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, small_dir, name):
    problem, _ = compare(spark, con, catalog.QUERIES[name], catalog.ORACLES.get(name), small_dir)
    assert problem is None, problem


def test_entry(spark, small_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
