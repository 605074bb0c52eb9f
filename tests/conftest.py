import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=4, shuffle_partitions=4, memory="4g")


@pytest.fixture
def bars(spark):
    """Make bars of one series from columns of values; missing prices default to the close."""

    def make(close, high=None, low=None, volume=None, symbol="BTC_USDT", timeframe="4h", start="2024-01-01", hours=4, **extra):
        t0 = datetime.fromisoformat(start)
        n = len(close)
        columns = {
            "open": close, "high": high or close, "low": low or close, "close": close, "volume": volume or [1.0] * n, **extra,
        }
        rows = [
            (symbol, timeframe, t0 + timedelta(hours=hours * i), *[None if v[i] is None else float(v[i]) for v in columns.values()])
            for i in range(n)
        ]
        schema = "symbol string, timeframe string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in columns)
        return spark.createDataFrame(rows, schema)

    return make
