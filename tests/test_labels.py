import random

import pytest

from barloom.operators.labels import Barrier, barrier_labels, barrier_labels_ltf, extrema_labels, label_grid


def labels(df, *cols):
    return [tuple(r) for r in df.orderBy("ts").select(*cols).collect()]


@pytest.mark.parametrize("high,low,expected", [
    ([100, 105, 130, 105, 105], [100, 85, 95, 95, 95], -1),
    ([100, 120, 105, 105, 105], [100, 95, 80, 95, 95], 1),
    ([100, 105, 105, 105, 105], [100, 95, 95, 95, 95], 0),
    ([100, 130, 105, 105, 105], [100, 70, 95, 95, 95], -1),  # both in one bar: the stop wins
])
def test_first_touch(bars, high, low, expected):
    df = bars([100.0] * 5, high, low, atr_14=[10.0] * 5)
    assert labels(barrier_labels(df, Barrier(3, 1.5, 1.0)), "target")[0] == (expected,)


def sequential(high, low, close, atr, b):
    out, n = [], len(close)
    for i in range(n):
        target = 0
        for j in range(i + 1, min(i + b.swing + 1, n)):
            if atr[i] is None:
                break
            if low[j] <= close[i] - atr[i] * b.sl:
                target = -1
                break
            if high[j] >= close[i] + atr[i] * b.tp:
                target = 1
                break
        ret = (
            atr[i] * b.tp / close[i] if target == 1
            else -atr[i] * b.sl / close[i] if target == -1
            else close[min(i + b.swing, n - 1)] / close[i] - 1
        )
        out.append((target, pytest.approx(ret), i + b.swing < n))
    return out


def test_grid_matches_a_loop(bars):
    rng = random.Random(3)
    close = [100 + rng.gauss(0, 4) for _ in range(150)]
    high, low = [c + rng.random() * 5 for c in close], [c - rng.random() * 5 for c in close]
    atr = [None] * 5 + [4.0 + rng.random() for _ in range(145)]
    grid = [Barrier(3, 1.0, 1.0), Barrier(10, 1.5, 1.0), Barrier(10, 2.0, 1.5)]
    out = label_grid(bars(close, high, low, atr_14=atr), grid)
    for b in grid:
        mine = out.filter(f"swing = {b.swing} AND tp = {b.tp} AND sl = {b.sl}")
        assert labels(mine, "target", "target_ret", "label_complete") == sequential(high, low, close, atr, b)


def test_lower_timeframe_decides(spark, bars):
    daily = bars([100.0] * 3, atr_14=[10.0] * 3, timeframe="1d", hours=24)
    up_first = bars([100] * 2, [115, 80], [98, 75], timeframe="1h", hours=1, start="2024-01-02")
    both = bars([100], [115], [85], timeframe="1h", hours=1, start="2024-01-02")
    one = Barrier(2, 1.5, 1.0)
    assert labels(barrier_labels_ltf(daily, up_first, "1d", one), "target")[0] == (1,)
    assert labels(barrier_labels_ltf(daily, both, "1d", one), "target")[0] == (-1,)
    # The lower bar that opens exactly at the end of the window counts, the next one does not.
    end = bars([100], [130], [99], timeframe="1h", hours=1, start="2024-01-03")
    late = bars([100], [130], [99], timeframe="1h", hours=1, start="2024-01-03T01:00:00")
    early = bars([100], [130], [99], timeframe="1h", hours=1, start="2024-01-01T23:00:00")
    assert labels(barrier_labels_ltf(daily, end, "1d", one), "target")[0] == (1,)
    assert labels(barrier_labels_ltf(daily, late, "1d", one), "target")[0] == (0,)
    assert labels(barrier_labels_ltf(daily, early, "1d", one), "target")[0] == (0,)


def test_extrema_label_needs_the_whole_window(bars):
    df = bars([100.0] * 5, [100, 116, 101, 101, 101], [99] * 5, atr_14=[10.0] * 5)
    assert [r[0] for r in labels(extrema_labels(df, Barrier(3, 1.5, 1.0)), "target_extrema")] == [1, 0, 0, 0, 0]
