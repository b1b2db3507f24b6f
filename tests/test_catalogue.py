"""Every catalogue query against its checking SQL."""

import pytest
from parity import connect, difference

from __spark_entry__ import entry, oracle_sql, queries
from auditloom.plans import catalogue

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()
CATALOGUE = catalogue.load()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query(spark, duck, name):
    assert name in SQL
    assert difference(spark, duck, CATALOGUE[name].run, SQL[name], SF) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_entry_registers_the_catalogue():
    assert set(CATALOGUE) <= set(queries())
