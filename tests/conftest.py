import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from monthloom.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def long(spark):
    """Dict of name -> list of values (None = missing) to a long table from 2020-01."""

    def build(series: dict, start="2020-01-01"):
        rows = []
        for name, values in series.items():
            for ds, v in zip(pd.date_range(start, periods=len(values), freq="MS"), values):
                rows.append((name, ds.date(), None if v is None else float(v)))
        return spark.createDataFrame(rows, "product string, ds date, y double")

    return build


@pytest.fixture(scope="session")
def patterns():
    """Trend, season, decline and step: 60 months each, never below 1."""
    rng = np.random.default_rng(42)
    t = np.arange(60)
    out = {
        "Trending": np.linspace(100, 200, 60) + 10 * rng.standard_normal(60),
        "Seasonal": 150 + 50 * np.sin(2 * np.pi * t / 12) + 8 * rng.standard_normal(60),
        "Declining": np.linspace(200, 100, 60) + 12 * rng.standard_normal(60),
        "Step Change": np.where(t < 30, 100, 180) + 15 * rng.standard_normal(60),
    }
    return {k: np.maximum(v, 1).tolist() for k, v in out.items()}
