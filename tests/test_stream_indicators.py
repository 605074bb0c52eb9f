"""The stream gives what the batch gives, from a state that does not grow."""

import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators.indicators import ALL, technicals
from barloom.schemas import BAR
from barloom.streaming.indicators import RING, Series, stream_indicators
from barloom.streaming.scan import closed_bars


def walk(symbol, n, seed, start="2024-01-01", flat=0):
    draw = random.Random(seed)
    price, rows = 100.0, []
    for i in range(n):
        price += 0.0 if i < flat else draw.gauss(0, 1)
        span = 0.0 if i < flat else draw.random() * 2
        rows.append((symbol, "4h", datetime.fromisoformat(start) + timedelta(hours=4 * i), price, price + span, price - span, price, float(draw.randint(0, 9))))
    return rows


def run(spark, batches, delay="2 days"):
    folder = tempfile.mkdtemp(prefix="barloom-indicators-")
    progress = []
    for rows in batches:
        spark.createDataFrame(rows, BAR).coalesce(1).write.mode("append").parquet(f"{folder}/landing")
        query = (
            stream_indicators(closed_bars(spark, f"{folder}/landing", 1), delay)
            .writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
        )
        assert query.awaitTermination(180)
        progress += query.recentProgress
    return spark.read.parquet(f"{folder}/out"), progress


@pytest.fixture(autouse=True)
def same_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_stream_equals_batch_for_shuffled_and_late_bars(spark):
    draw = random.Random(3)
    a, b = walk("A", 130, 1), walk("B", 70, 2, flat=40)
    bars = sorted(a + b, key=lambda r: r[2])
    # Within the delay of two days (12 bars) bars land in any order.
    order = sorted(range(len(bars)), key=lambda i: bars[i][2] + timedelta(hours=draw.uniform(0, 30)))
    landed = [bars[i] for i in order]
    end = ("END", "4h", datetime(2030, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)
    late = (*a[0][:3], 500.0, 500.0, 500.0, 500.0, 500.0)
    twice = (*a[129][:3], 1.0, 1.0, 1.0, 1.0, 1.0)
    third = len(landed) // 3
    batches = [landed[:third], [*landed[third : 2 * third], late], [twice, *landed[2 * third :], a[129]], [end], [late]]
    out, progress = run(spark, batches)
    got = {(r["symbol"], r["ts"]): r for r in out.collect()}
    want = technicals(spark.createDataFrame(bars, BAR)).collect()
    assert len(got) == len(want) == 200
    for r in want:
        own = got[r["symbol"], r["ts"]]
        assert own["rn"] == r["rn"] and own["close"] == r["close"]
        for c in ALL:
            assert own[c] == (None if r[c] is None else pytest.approx(r[c], rel=1e-9, abs=1e-9)), (c, r["symbol"], r["rn"])
    dropped = sum(int(s["numRowsDroppedByWatermark"]) for p in progress for s in p["stateOperators"])
    assert dropped + max(r["late"] for r in got.values()) >= 1
    # One state per series, whatever the history.
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2 * 3 + 3


def test_state_does_not_grow():
    series, sizes = Series(), set()
    for i in range(3000):
        series.add(100.0 + i % 7, 99.0 - i % 5, 99.5 + i % 3, 1.0)
        n, numbers, ring, raw_k = series.stored()
        series = Series(n, numbers, ring, raw_k)
        if i >= RING:
            sizes.add((len(numbers), len(ring), len(raw_k)))
    assert sizes == {(13, 4 * RING, 3)}


def test_a_restored_series_goes_on_as_before():
    whole, parts = Series(), Series()
    for _, _, _, _, high, low, close, volume in walk("A", 120, 9):
        one = whole.add(high, low, close, volume)
        parts = Series(*parts.stored())
        assert parts.add(high, low, close, volume) == one
