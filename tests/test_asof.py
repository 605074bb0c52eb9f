"""Leakage boundaries of every enrichment."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators.asof import asof_daily, asof_join, keep_last
from barloom.plans import enrich

D = datetime


def probes(spark, instants, symbol="BTC_USDT"):
    return spark.createDataFrame([(symbol, t) for t in instants], "symbol string, ts timestamp_ntz")


def values(df, column):
    return [r[0] for r in df.orderBy("ts").select(column).collect()]


def daily(spark, start, vals, column):
    rows = [(start + timedelta(days=i), float(v)) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, f"ts timestamp_ntz, {column} double")


def test_funding_is_known_from_its_settlement_on(spark):
    rates = [(D(2024, 1, 2, 0), -10.0), (D(2024, 1, 2, 8), 5.0), (D(2024, 1, 2, 16), -20.0)]
    funding = spark.createDataFrame([("BTC_USDT", t, v) for t, v in rates], "symbol string, ts timestamp_ntz, funding_rate double")
    at = [D(2024, 1, 1, 23, 59, 59), D(2024, 1, 2, 7, 59, 59), D(2024, 1, 2, 8), D(2024, 1, 2, 8, 0, 1), D(2024, 1, 2, 15, 59, 59), D(2024, 1, 3)]
    out = enrich.add_funding_rate(probes(spark, at), funding)
    assert values(out, "funding_rate_current") == [None, -10.0, 5.0, 5.0, 5.0, -20.0]
    other = enrich.add_funding_rate(probes(spark, at, "ETH_USDT"), funding)
    assert values(other, "funding_rate_current") == [None] * 6


@pytest.mark.parametrize("fn,column,lag", [
    (enrich.add_onchain_active_addresses, "onchain_active_addresses", 2),
    (enrich.add_mempool_fee_rate, "mempool_fee_rate_p50", 1),
])
def test_daily_series_lag(spark, fn, column, lag):
    start = D(2020, 1, 1)
    right = daily(spark, start, range(10, 40), column)
    at = [start + timedelta(hours=4 * i) for i in range(6 * 35)]
    got = values(fn(probes(spark, at), right), column)
    for t, v in zip(at, got):
        day = (t - start).days - lag
        assert v == (None if day < 0 else float(10 + min(day, 29)))


def test_sentiment_off_the_midnight_grid(spark):
    right = daily(spark, D(2022, 12, 1), range(40), "fng_value")
    at = [D(2023, 1, 1, 2) + timedelta(hours=4 * i) for i in range(100)]
    out = enrich.add_sentiment(probes(spark, at), right)
    assert out.filter("fng_value IS NULL OR fng_sma_14 IS NULL OR fng_vol_14 IS NULL").count() == 0
    assert values(out, "fng_value")[0] == 31.0


def test_trend_counts_a_daily_bar_from_its_close(spark, bars):
    day = bars([float(100 + i) for i in range(300)], timeframe="1d", start="2023-01-01", hours=24)
    last = D(2023, 1, 1) + timedelta(days=251)
    at = [last + timedelta(hours=20), last + timedelta(days=1) - timedelta(seconds=1), last + timedelta(days=1)]
    got = values(enrich.add_trend_htf(probes(spark, at), day), "trend_htf")
    trend = {r.ts: r.trend_htf for r in enrich.daily_trend(day).collect()}
    assert got == [trend[last - timedelta(days=1)]] * 2 + [trend[last]]
    # Changing the running day changes nothing during that day.
    changed = day.withColumn("close", F.when(F.col("ts") == last, 1e6).otherwise(F.col("close")))
    assert values(enrich.add_trend_htf(probes(spark, at), changed), "trend_htf")[:2] == got[:2]


def test_matched_null_stays_null_and_buckets_do_not_matter(spark):
    right = spark.createDataFrame(
        [("s", D(2024, 1, 1), 1.0), ("s", D(2024, 1, 5), None), ("s", D(2024, 3, 1), 3.0)], "symbol string, ts timestamp_ntz, v double"
    )
    at = [D(2023, 12, 31), D(2024, 1, 1), D(2024, 1, 4), D(2024, 1, 6), D(2024, 2, 20), D(2024, 3, 1), D(2024, 5, 1)]
    left = probes(spark, at, "s")
    expected = [None, 1.0, 1.0, None, None, 3.0, 3.0]
    for bucket in (timedelta(hours=6), timedelta(days=1), timedelta(days=365)):
        assert values(asof_join(left, right, ["v"], timedelta(0), ["symbol"], bucket=bucket), "v") == expected
    assert values(asof_daily(left, right, ["v"], timedelta(0), ["symbol"]), "v") == expected
    assert values(asof_daily(left, right.drop("symbol"), ["v"], timedelta(0)), "v") == expected


def test_daily_join_refuses_intraday_rows_and_keeps_one_row_a_day(spark):
    left = probes(spark, [D(2024, 1, 1), D(2024, 1, 1, 12), D(2024, 1, 2, 4)], "s")
    twice = spark.createDataFrame([("s", D(2024, 1, 1), 1.0), ("s", D(2024, 1, 1), 2.0)], "symbol string, ts timestamp_ntz, v double")
    for by, right in ((["symbol"], twice), ([], twice.drop("symbol"))):
        assert values(asof_daily(left, right, ["v"], timedelta(0), by), "v") == [2.0, 2.0, 2.0]
    late = spark.createDataFrame([("s", D(2024, 1, 1, 20), 1.0), ("s", D(2024, 1, 2, 3), 2.0)], "symbol string, ts timestamp_ntz, v double")
    with pytest.raises(Exception, match="midnight"):
        asof_daily(left, late, ["v"], timedelta(0), ["symbol"]).collect()


def test_lag_of_part_of_a_day_is_refused(spark):
    with pytest.raises(ValueError):
        asof_daily(probes(spark, [D(2024, 1, 1)]), daily(spark, D(2024, 1, 1), [1], "v"), ["v"], timedelta(hours=5))


def test_keep_last(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 3.0), ("a", 2, 2.0), ("b", 1, None)], "k string, seq int, v double")
    assert sorted((r.k, r.v) for r in keep_last(df, ["k"], "seq").collect()) == [("a", 3.0), ("b", None)]
