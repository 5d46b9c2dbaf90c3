"""Registered queries against their SQL, on the whole small tables."""

import pytest

from tests.oracle_compare import connect, differences
from tillwise.llm.oracle import ORACLE
from tillwise.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, connection, name):
    assert differences(QUERIES[name](spark, FOLDER), connection, ORACLE[name]) == []
