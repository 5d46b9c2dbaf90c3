"""Registered queries against their SQL. ALL_QUERIES=1 runs every one, otherwise one or two per operator group."""

import os

import pytest

from catalog.oracle import ORACLE
from catalog.queries import QUERIES
from tests.oracle_compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "kpi_snapshot", "kpi_texts", "customer_segments_scaled", "worst_products", "adhoc_sql", "trend_quarterly",
    "trend_insights", "rca_contributors", "rca_explanations", "quality_report", "column_report", "clean_actions",
    "clean_rows", "forecast_by_category", "forecast_rows", "recommendations_all", "kpi_history", "sales_json",
    "csv_roundtrip", "mom_calendar", "revenue_ytd", "star_measures_by_product",
]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("ALL_QUERIES") else QUICK)
def test_query_equals_sql(spark, connection, name):
    assert differences(QUERIES[name](spark, FOLDER), connection, ORACLE[name]) == []
