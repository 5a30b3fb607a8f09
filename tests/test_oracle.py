"""Every registered query against its DuckDB twin."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.check import connect, difference

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert contract.FLAGSHIP in QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, folder, duck):
    found = QUERIES[name](spark, folder).toPandas()
    if name in ORACLES:
        assert difference(found, duck.execute(ORACLES[name]).df()) is None
    else:
        assert len(found)
