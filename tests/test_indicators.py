import math

import pytest
from pyspark.sql import functions as F

from barloom.operators.indicators import ALL, ema, technicals
from barloom.plans.enrich import add_taker_buy_ratio


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("ts").select(*cols).collect()]


def test_future_bars_change_nothing_before(bars):
    close = [100 + 10 * math.sin(i / 3) + i % 5 for i in range(120)]
    high, low = [c + 2 for c in close], [c - 2 for c in close]
    changed = close[:80] + [c * 3 for c in close[80:]]
    before = rows(technicals(bars(close, high, low)), "ts", *ALL)
    after = rows(technicals(bars(changed, [c + 2 for c in changed], [c - 2 for c in changed])), "ts", *ALL)
    assert before[:80] == after[:80]
    assert before[80:] != after[80:]


@pytest.mark.parametrize("case", ["constant", "zero_volume", "zero_close", "three"])
def test_degenerate_bars_give_null_not_failure(bars, case):
    n = 3 if case == "three" else 60
    close = [0.0 if case == "zero_close" else 50.0] * n
    out = technicals(bars(close, volume=[0.0 if case == "zero_volume" else 2.0] * n))
    last = out.orderBy(F.desc("ts")).first()
    assert last.rsi_14 is None and last.stoch_k is None
    for c in ALL:
        assert last[c] is None or math.isfinite(last[c])


def test_warm_up_lengths(bars):
    close = [100 + (i * 7) % 13 for i in range(70)]
    out = rows(technicals(bars(close, [c + 1 for c in close], [c - 1 for c in close])), "rsi_14", "macd", "macd_hist", "ema_50", "adx_14", "atr_14", "stoch_k", "bb_width")
    first = [next(i for i, r in enumerate(out) if r[j] is not None) for j in range(8)]
    assert first == [14, 25, 33, 49, 27, 13, 15, 19]


def test_partitioning_does_not_matter(spark, bars):
    close = [100 + (i * 11) % 17 for i in range(90)]
    df = bars(close)
    assert rows(technicals(df.repartition(7)), *ALL) == rows(technicals(df.coalesce(1)), *ALL)


def test_ema_of_constant_is_constant(bars):
    out = rows(ema(bars([5.0] * 12), "close", 10, "e"), "e")
    assert [r[0] for r in out] == [None] * 9 + [pytest.approx(5.0)] * 3


def test_taker_ratio(bars):
    vol = [10, 20, 5, 0, 100, 2, 7, 0]
    taker = [8, 5, 5, 0, 1, 1, 0, 3]
    out = rows(add_taker_buy_ratio(bars([1.0] * 8, volume=vol, taker_buy_base_vol=taker)), "taker_buy_ratio")
    assert [r[0] for r in out] == [0.8, 0.25, 1.0, None, 0.01, 0.5, 0.0, None]


def test_unknown_indicator(bars):
    with pytest.raises(ValueError, match="unknown"):
        technicals(bars([1.0]), ["nope"])
