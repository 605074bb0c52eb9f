import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barloom import schemas
from barloom.operators import sizing
from barloom.plans import sweep
from barloom.sources import normalise, tables


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="barloom-test-")


def test_bars_round_trip_and_pruning(spark, bars, folder):
    df = bars([1.0, 2.0, 3.0], symbol="BTC/USDT")
    tables.write_bars(df, f"{folder}/bars")
    back = tables.read_bars(spark, f"{folder}/bars", schemas.BAR)
    assert [r.close for r in back.orderBy("ts").collect()] == [1.0, 2.0, 3.0]
    plan = back.filter("symbol = 'BTC_USDT' AND ts >= TIMESTAMP_NTZ '2024-01-01 04:00:00'").select("close")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan and "PushedFilters: [IsNotNull(ts)" in plan
    with pytest.raises(FileNotFoundError):
        tables.read_bars(spark, f"{folder}/missing")


def test_csv_daily_bars_open_at_midnight(spark, folder):
    rows = spark.sql("SELECT 'X_USDT' AS symbol, tf AS timeframe, '2024-01-02 04:00:00' AS timestamp, 1D open, 2D high, 0.5D low, 1.5D close, 9D volume FROM VALUES ('1d'), ('4h') t(tf)")
    rows.write.partitionBy("symbol", "timeframe").option("header", True).csv(f"{folder}/csv")
    got = {r.timeframe: r.ts for r in tables.read_bars_csv(spark, f"{folder}/csv").collect()}
    assert got == {"1d": datetime(2024, 1, 2), "4h": datetime(2024, 1, 2, 4)}


def test_missing_series_is_empty(spark, folder):
    assert tables.read_series(spark, f"{folder}/none", schemas.FUNDING).count() == 0


def test_reports_and_resume(spark, folder):
    first = spark.createDataFrame([(1, 0.5)], "k int, v double")
    tables.write_report(first, f"{folder}/r", "baseline", "20240101_000000")
    tables.write_report(first.withColumn("v", F.lit(0.7)), f"{folder}/r", "baseline", "20240102_000000")
    assert [r.v for r in tables.latest_report(spark, f"{folder}/r", "baseline", first.schema).collect()] == [0.7]
    slots = sweep.sweep_slots(spark)
    assert slots.count() == 53 and slots.filter("timeframe = '4h'").count() == 27
    tables.append_results(slots.filter("swing = 5"), f"{folder}/log")
    left = tables.pending(slots, spark.read.parquet(f"{folder}/log"), sweep.SLOT_KEYS)
    assert left.filter("swing = 5").count() == 0 and left.count() == slots.filter("swing <> 5").count()
    tables.write_csv_report(first, f"{folder}/csv")
    assert spark.read.option("header", True).csv(f"{folder}/csv").count() == 1


def test_latest(bars):
    df = bars([float(i) for i in range(150)])
    assert sorted(r.close for r in tables.latest_bars(df, 100).collect()) == [float(i) for i in range(50, 150)]
    assert tables.latest_bar(df).first().close == 149.0


def test_mempool_days(spark):
    # Instants near noon belong to the day they fall into.
    items = [(1704113640, "2024-01-01"), (1704195900, "2024-01-02"), (1704285540, "2024-01-03")]
    payload = "[" + ",".join(f'{{"timestamp":{s},"avgFee_50":{i}}}' for i, (s, _) in enumerate(items)) + ',{"timestamp":1704285540,"avgFee_50":"x"}]'
    out = normalise.mempool_fee_rates(spark.createDataFrame([(payload, 1)], "payload string, ingest_seq long"))
    got = {str(r.ts.date()): r.mempool_fee_rate_p50 for r in out.collect()}
    assert got == {"2024-01-01": 0.0, "2024-01-02": 1.0, "2024-01-03": None}


def test_rounding(spark):
    cases = [(1.567, "0.01", 1.56), (0.12345, "0.001", 0.123), (65432.789, "0.01", 65432.78), (0.3, "0.1", 0.3)]
    df = spark.createDataFrame(cases, "v double, s string, e double")
    for r in df.select(sizing.floor_to_step(F.col("v"), F.col("s")).cast("double").alias("g"), "e").collect():
        assert r.g == r.e


def test_position_size(spark):
    signals = spark.sql("SELECT * FROM VALUES ('A', 50000D), ('B', 50000D), ('C', 1e9D), ('D', 0D), ('E', 10D) t(symbol, close)")
    filters = spark.sql("""SELECT symbol, CAST(0.001 AS DECIMAL(28,10)) step, CAST(q AS DECIMAL(28,10)) min_qty, CAST(m AS DECIMAL(28,10)) min_notional,
        CAST(0.01 AS DECIMAL(28,10)) tick FROM VALUES ('A', 0.001, 5), ('B', 0.001, 600), ('C', 0.001, 5), ('D', 0.001, 5) t(symbol, q, m)""")
    out = {r.symbol: r for r in sizing.position_size(signals, filters, 10_000.0).collect()}
    assert float(out["A"].quantity) == 0.01 and out["A"].reject_reason is None
    assert [out[s].reject_reason for s in "BCDE"] == ["below_min_notional", "below_min_qty", "bad_price", "unknown_symbol"]


def test_barrier_prices_without_atr(spark):
    df = spark.sql("SELECT 100D AS close, 103D AS high, 99D AS low, t.atr_14 FROM VALUES (2D), (0D) t(atr_14)")
    got = [(r.tp, r.sl) for r in sizing.barrier_prices(df, F.lit(1.5), F.lit(1.0)).collect()]
    assert got == [(103.0, 98.0), (106.0, 96.0)]


def test_training_freshness(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ '2024-01-01'), (TIMESTAMP_NTZ '2024-01-10'), (CAST(NULL AS TIMESTAMP_NTZ)) t(last_trained)")
    got = [r.needs_training for r in sizing.needs_training(df, F.expr("TIMESTAMP_NTZ '2024-01-15'")).collect()]
    assert got == [True, False, True]
