import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]").appName("hydrolens-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


def ts(s: str) -> dt.datetime:
    return dt.datetime.strptime(s, "%Y-%m-%d %H:%M")


# Hand fixture H1 (FIXTURES.md §3): enriched readings with hand-worked answers.
H1_ROWS = [
    ("HH000001", "2024-01-01 00:00", 0, 10.0, 1.0, 0, "Normal", 0.10, "Low Risk"),
    ("HH000001", "2024-01-01 06:00", 6, 20.0, 2.0, 0, "Moderate Risk", 0.50, "Moderate Risk"),
    ("HH000001", "2024-01-01 12:00", 12, 60.0, 3.0, 1, "Critical Leak", 0.95, "Critical"),
    ("HH000001", "2024-02-01 03:00", 3, 30.0, 0.5, 0, "Normal", 0.05, "Low Risk"),
    ("HH000002", "2024-01-01 06:00", 6, 40.0, 2.5, 1, "High Risk", 0.85, "High Risk"),
    ("HH000002", "2024-01-01 12:00", 12, 40.0, 1.5, 0, "Low Risk", 0.30, "Low Risk"),
    ("HH000002", "2024-01-02 18:00", 18, 12.0, 99.5, 1, "Critical Leak", 0.99, "Critical"),
    ("HH000003", "2024-01-02 05:00", 5, 8.0, 0.0, 0, "Normal", 0.00, "Low Risk"),
]


@pytest.fixture(scope="session")
def h1(spark):
    """H1 as readings (schema order: id, ts, hour, usage, spike, prob, flag, severity, risk)."""
    from hydrolens.schema import READINGS
    rows = [(hid, ts(t), hour, usage, spike, prob, flag, sev, risk)
            for (hid, t, hour, usage, spike, flag, sev, prob, risk) in H1_ROWS]
    return spark.createDataFrame(rows, READINGS)
