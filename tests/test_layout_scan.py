"""Block edges must not show: every result is compared with a sequential loop."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators.indicators import ema
from barloom.operators.layout import block_window, drop_halo, with_halo, with_position
from barloom.operators.scan import ema_term, forward_fill, linear_recurrence, memory_rows, rma_term, running_sum

N, BLOCK = 13_000, 4_096
KEYS = ["symbol", "timeframe"]


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(5)
    rows, values = [], {}
    for symbol, n in (("A", N), ("B", 57)):
        xs = [100 + rng.random() * 10 for _ in range(n)]
        values[symbol] = xs
        t = datetime(2020, 1, 1)
        for i, x in enumerate(xs):
            t += timedelta(hours=rng.choice([1, 1, 1, 5, 2000 if i % 997 == 0 else 1]))
            rows.append((symbol, "1h", t, x, x if i % 700 == 3 else None))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp_ntz, x double, sparse double")
    placed = with_position(df, last="x").cache()
    return placed, values


def test_positions_count_rows_over_buckets(series):
    placed, values = series
    for row in placed.select("symbol", "rn", "x", "n_bars", "last_x").collect():
        assert row.x == values[row.symbol][row.rn]
        assert row.n_bars == len(values[row.symbol])
        assert row.last_x == values[row.symbol][-1]


def test_frames_cross_block_edges(series):
    placed, values = series
    w = block_window()
    out = with_halo(placed, back=5, fwd=3, rows=BLOCK)
    out = out.withColumn("s", F.sum("x").over(w.rowsBetween(-5, 3)))
    for row in drop_halo(out).select("symbol", "rn", "s").collect():
        xs = values[row.symbol]
        assert row.s == pytest.approx(sum(xs[max(0, row.rn - 5) : row.rn + 4]))


def test_recurrences_match_a_loop(series):
    placed, values = series
    out = with_halo(placed, back=memory_rows(0.8), rows=BLOCK)
    w = block_window().rowsBetween(-(10**9), 0)
    out = out.withColumn("_mean", F.avg("x").over(w))
    out = linear_recurrence(out, {"ema9": ema_term(F.col("x"), 9, 0, F.col("_mean")), "rma4": rma_term(F.col("x"), 4, 1)})
    got = {(r.symbol, r.rn): (r.ema9, r.rma4) for r in drop_halo(out).select("symbol", "rn", "ema9", "rma4").collect()}
    assert len(got) == N + 57
    for symbol, xs in values.items():
        ema, rma = None, None
        for i, x in enumerate(xs):
            if i == 8:
                ema = sum(xs[:9]) / 9
            elif i > 8:
                ema = 0.8 * ema + 0.2 * x
            if i == 1:
                rma = x
            elif i > 1:
                rma = 0.75 * rma + x / 4
            if ema is not None:
                assert got[symbol, i][0] == pytest.approx(ema, rel=1e-12)
            if rma is not None:
                assert got[symbol, i][1] == pytest.approx(rma, rel=1e-12)


def test_running_sum_and_forward_fill_cross_blocks(series):
    placed, values = series
    blocked = drop_halo(with_halo(placed, rows=BLOCK))
    out = forward_fill(running_sum(blocked, {"total": F.col("x")}), "sparse", out="filled")
    got = {(r.symbol, r.rn): (r.total, r.filled) for r in out.select("symbol", "rn", "total", "filled").collect()}
    for symbol, xs in values.items():
        total, filled = 0.0, None
        for i, x in enumerate(xs):
            total += x
            filled = x if i % 700 == 3 else filled
            assert got[symbol, i][0] == pytest.approx(total)
            assert got[symbol, i][1] == filled


def test_a_block_is_at_least_as_long_as_its_frame(series):
    placed, values = series
    out = with_halo(placed, back=BLOCK + 1, rows=BLOCK).groupBy("symbol", "_blk").agg(F.count_if("_own").alias("n"))
    longest = max(len(v) for v in values.values())
    assert out.agg(F.max("n")).first()[0] == min(2 * BLOCK, longest)
    with pytest.raises(ValueError, match="decay"):
        linear_recurrence(with_halo(placed), {"y": (F.col("x"), 1.0)})


@pytest.mark.parametrize("n", [2, 5, 6, 20, 700, 800, 2000])
def test_ema_of_any_length_matches_a_loop(series, n):
    placed, values = series
    got = {(r.symbol, r.rn): r.e for r in ema(placed, "x", n, "e").select("symbol", "rn", "e").collect()}
    for symbol, xs in values.items():
        y = None
        for i, x in enumerate(xs):
            y = sum(xs[:n]) / n if i == n - 1 else y if y is None else y + (x - y) * 2 / (n + 1)
            assert got[symbol, i] is None if y is None else got[symbol, i] == pytest.approx(y, rel=1e-9)
