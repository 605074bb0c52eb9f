import pytest
from pyspark.sql import functions as F

from barloom.functions.keys import bar_open, canonical_symbol, parse_timeframe, timeframe_hours


def test_symbols(spark):
    raw = ["BTC/USDT", "BTC/USDT:USDT", "BTC_USDT", "BTCUSD"]
    got = spark.createDataFrame([(r,) for r in raw], "s string").select(canonical_symbol(F.col("s"))).collect()
    assert [r[0] for r in got] == ["BTC_USDT", "BTC_USDT", "BTC_USDT", "BTCUSD_USDT"]


def test_timeframes(spark):
    cases = {"30s": 30 / 3600, "15m": 0.25, "4h": 4.0, "1d": 24.0, "2w": 336.0, "1M": 720.0}
    got = spark.createDataFrame([(c,) for c in cases], "t string").select("t", timeframe_hours(F.col("t")).alias("h")).collect()
    for row in got:
        assert row.h == pytest.approx(cases[row.t]) == parse_timeframe(row.t)


def test_unknown_timeframe_fails(spark):
    with pytest.raises(ValueError):
        parse_timeframe("4x")
    with pytest.raises(Exception, match="unsupported timeframe"):
        spark.createDataFrame([("4x",)], "t string").select(timeframe_hours(F.col("t"))).collect()


def test_only_daily_bars_move_to_midnight(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-02 04:00:00' AS ts, explode(array('1d', '4h')) AS tf")
    got = {r.tf: r.o.hour for r in df.select("tf", bar_open(F.col("ts"), F.col("tf")).alias("o")).collect()}
    assert got == {"1d": 0, "4h": 4}
