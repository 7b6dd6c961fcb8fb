"""Every registered query against its SQL on the smallest tables, and the driver contract."""

import os

import pytest

import __spark_entry__ as contract
from forecourt.queries import QUERIES, SQL
from tests.compare import connect, difference

SF_DIR = contract.SMOKE_DIR
# Errors of fitted models: no SQL gives them.
WITHOUT_SQL = {"compare_models"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


def test_every_query_has_sql_but_the_models():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, name):
    assert difference(spark, connect(SF_DIR), QUERIES[name], SQL[name], SF_DIR) is None


def test_contract_holds_all_queries():
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_models(spark):
    assert QUERIES["compare_models"](spark, SF_DIR).count() == 3
