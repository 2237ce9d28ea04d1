import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from barloom.session import local_session

    s = local_session("*")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def bars20(spark):
    """One symbol, 20 days, closes given literally."""
    import datetime as dt

    closes = [10.0, 10.5, 11.0, 10.8, 11.2, 11.5, 11.3, 11.8, 12.0, 11.9, 12.2, 12.5, 12.3, 12.8, 13.0, 12.8, 13.2, 13.5, 13.3, 13.8]
    rows = [
        ("000001", dt.date(2024, 1, 1) + dt.timedelta(days=i), c - 0.1, c + 0.2, c - 0.2, c, 1000 * (1 + 0.1 * i), c * 100000)
        for i, c in enumerate(closes)
    ]
    return spark.createDataFrame(
        rows, "symbol string, date date, open double, high double, low double, close double, volume double, amount double"
    )
