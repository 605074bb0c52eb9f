import calendar
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators.folds import fold_bounds, fold_slices, fold_windows
from barloom.operators.layout import with_position
from barloom.operators.splits import split_sizes, temporal_split
from barloom.operators.trades import with_exit_close


@pytest.mark.parametrize("n,swing,embargo,kw,expected", [
    (5000, 5, 5, {}, (3492, 748, 748)),
    (100, 5, 5, {}, None),
    (1500, 10, 10, {"val_trades": 20, "test_trades": None}, None),
    (2000, 10, 10, {"val_trades": 15, "test_trades": 15}, None),
])
def test_split_sizes(spark, n, swing, embargo, kw, expected):
    df = spark.createDataFrame([("s", "1d", n)], "symbol string, timeframe string, n_bars long")
    row = split_sizes(df, swing, embargo, **kw).first()
    got = None if row.n_train is None else (row.n_train, row.n_val, row.n_test)
    if expected is None:
        assert got is None and row.split_reason is not None
    else:
        assert got == (5000 - 10 - 748 - 748, 748, 748) and sum(got) == 4990


def test_gaps_stay_unlabelled(spark):
    df = spark.range(3000).select(F.lit("s").alias("symbol"), F.lit("1d").alias("timeframe"),
                                  (F.lit("2000-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))).alias("ts"))
    out = temporal_split(df, swing=5, embargo=7)
    ranges = {r.split: (r.lo, r.hi) for r in out.filter("split IS NOT NULL").groupBy("split").agg(F.min("rn").alias("lo"), F.max("rn").alias("hi")).collect()}
    assert ranges["val"][0] - ranges["train"][1] == 8 and ranges["test"][0] - ranges["val"][1] == 8
    assert ranges["train"][0] == 0 and ranges["test"][1] == 2999


def plus_months(t, n):
    month = t.month - 1 + n
    year, month = t.year + month // 12, month % 12 + 1
    return t.replace(year=year, month=month, day=min(t.day, calendar.monthrange(year, month)[1]))


def test_folds_step_from_the_previous_start(spark):
    start = datetime(2024, 1, 31, 4)
    rows = [("s", "4h", start + timedelta(hours=4 * i)) for i in range(6 * 400)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp_ntz")
    got = [(r.start, r.end) for r in fold_windows(df, 2, 1).orderBy("fold").collect()]
    expected, at, last = [], plus_months(start, 1), rows[-1][2]
    while at < last and plus_months(at, 2) <= last:
        expected.append((at, plus_months(at, 2)))
        at = plus_months(at, 1)
    assert got == expected
    assert got[1][0].day == 29  # January 31st, then February 29th, then March 29th


def test_bounds_and_slices_match_counting(spark):
    start = datetime(2020, 1, 1)
    times = [start + timedelta(days=i) for i in range(1900) if i % 11]
    rows = [("s", "1d", t, 100.0 + i % 7, 1.0, 0) for i, t in enumerate(times)]
    bars = with_position(spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp_ntz, close double, atr_14 double, target int"))
    bounds = fold_bounds(bars, fold_windows(bars, 6, 6), swing=10).cache()
    usable = 0
    for r in bounds.orderBy("fold").collect():
        assert r.n_prior == sum(t < r.start - timedelta(days=10) for t in times)
        assert (r.oos_lo, r.oos_hi) == (sum(t < r.start for t in times), sum(t < r.end for t in times))
        if r.skipped_reason is None:
            usable += 1
            assert r.val_hi == r.n_prior and r.val_lo == r.n_train + 10
    assert usable >= 3
    ready = with_exit_close(bars, 10, ["symbol", "timeframe"])
    for r in fold_slices(ready, bounds, ("val", "oos"), ("ts", "close", "close_ahead")).join(bounds, ["symbol", "timeframe", "fold"]).collect():
        lo, hi = (r.val_lo, r.val_hi) if r.part == "val" else (r.oos_lo, r.oos_hi)
        assert r.ts == times[lo + r.pos]
        assert r.exit_close == rows[min(lo + r.pos + 10, hi - 1)][3]
