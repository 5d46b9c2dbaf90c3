import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tillwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", "tillwise-tests", **{"spark.ui.showConsoleProgress": "false"})
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sales(spark):
    """Six lines over three months."""
    rows = [
        (date(2026, 1, 1), "O1", "C1", "Laptop", "Electronics", 1000.0, 800.0, 200.0, 1.0),
        (date(2026, 1, 15), "O2", "C2", "Mouse", "Electronics", 50.0, 30.0, 20.0, 2.0),
        (date(2026, 2, 1), "O3", "C1", "Laptop", "Electronics", 800.0, 700.0, 100.0, 1.0),
        (date(2026, 2, 15), "O4", "C2", "Mouse", "Electronics", 40.0, 25.0, 15.0, 2.0),
        (date(2026, 3, 1), "O5", "C1", "Laptop", "Electronics", 900.0, 600.0, 300.0, 1.0),
        (date(2026, 3, 15), "O6", "C3", "Mouse", "Electronics", 45.0, 20.0, 25.0, 2.0),
    ]
    return spark.createDataFrame(
        rows,
        "Date date, Order_ID string, Customer_ID string, Product string, Category string, "
        "Revenue double, Cost double, Profit double, Quantity double",
    )


@pytest.fixture(scope="session")
def shop(spark):
    """Five lines of one month, with hand-computed results in the tests."""
    rows = [
        (date(2024, 1, 1), "O101", "C001", "Laptop", "Electronics", 50000.0, 40000.0, 10000.0, 1.0),
        (date(2024, 1, 2), "O102", "C002", "Mouse", "Electronics", 1000.0, 600.0, 400.0, 2.0),
        (date(2024, 1, 3), "O103", "C003", "Chair", "Furniture", 5000.0, 3000.0, 2000.0, 1.0),
        (date(2024, 1, 4), "O104", "C004", "Desk", "Furniture", 8000.0, 5000.0, 3000.0, 1.0),
        (date(2024, 1, 5), "O105", "C005", "Monitor", "Electronics", 12000.0, 9000.0, 3000.0, 1.0),
    ]
    return spark.createDataFrame(
        rows,
        "Date date, Order_ID string, Customer_ID string, Product string, Category string, "
        "Revenue double, Cost double, Profit double, Quantity double",
    )
