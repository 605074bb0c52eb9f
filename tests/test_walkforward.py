"""Synthetic edge must pass the gate, noise and too little data must not."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.layout import with_position
from barloom.plans import walkforward as wf
from barloom.plans.config import BINARY_GRID, ExperimentConfig
from barloom.operators.trades import threshold_grid

CONFIG = ExperimentConfig(n_bootstrap=100)
GRID = threshold_grid(*BINARY_GRID)


def synthetic(n, edge, symbol, seed):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 0.1, n))
    close = np.maximum(close, 20)
    target = rng.choice([-1, 0, 1], n, p=[0.4, 0.2, 0.4])
    noise = rng.random(n)
    score = np.where(target == 1, 0.6 + 0.4 * noise, 0.6 * noise) if edge else noise
    start = datetime(2018, 1, 1)
    return pd.DataFrame({
        "symbol": symbol, "timeframe": "4h", "ts": [start + timedelta(hours=4 * i) for i in range(n)],
        "close": close, "atr_14": close * 0.02, "target": target, "feature_1": score,
    })


@pytest.fixture(scope="module")
def result(spark):
    frames = [synthetic(10_000, True, "EDGE", 1), synthetic(10_000, False, "NOISE", 2), synthetic(3_500, True, "SHORT", 3)]
    return evaluate(spark, frames, CONFIG)


def evaluate(spark, frames, config):
    schema = "symbol string, timeframe string, ts timestamp_ntz, close double, atr_14 double, target int, feature_1 double"
    bars = with_position(spark.createDataFrame(pd.concat(frames), schema))
    ready, bounds = wf.prepare(bars, config)
    score = lambda s: s.withColumn("score", F.col("feature_1"))
    return wf.evaluate(ready, bounds, score, config, GRID, columns=["feature_1"])


def test_gate(result):
    runs = {r.symbol: r for r in result.runs.collect()}
    assert runs["EDGE"].passes_gate and runs["EDGE"].p5 > 0 and runs["EDGE"].pooled_trades >= 300
    assert not runs["NOISE"].passes_gate
    assert not runs["SHORT"].passes_gate and runs["SHORT"].pooled_trades < 300
    for r in runs.values():
        assert r.total_windows == r.windows_used + r.windows_skipped


def test_skipped_windows_stay_as_zero_rows(spark):
    config = ExperimentConfig(window_months=1, step_months=1, n_bootstrap=10)
    tiny = evaluate(spark, [synthetic(500, False, "TINY", 4)], config)
    run = tiny.runs.first()
    assert run.windows_used == 0 and run.windows_skipped > 0 and not run.passes_gate and run.p5 is None
    for r in tiny.windows.collect():
        assert r.skipped_reason == "insufficient_prior_data"
        assert (r.cum_ret, r.vol, r.threshold, r.model_pf, r.naive_pf, r.delta, r.model_trade_count) == (0, 0, 0, 0, 0, 0, 0)


def test_trades_respect_the_cooldown_and_the_window(result):
    trades = result.trades.toPandas()
    for _, run in trades[trades.side == "model"].groupby(["symbol", "fold"]):
        assert (np.diff(np.sort(run.pos)) >= CONFIG.swing_period).all()
    bounds = {(r.symbol, r.fold): (r.start, r.end) for r in result.bounds.collect()}
    for row in trades.itertuples():
        start, end = bounds[row.symbol, row.fold]
        assert start <= row.ts < end


def test_series_without_usable_folds_keep_their_rows_per_run(spark):
    schema = "symbol string, timeframe string, ts timestamp_ntz, close double, atr_14 double, target int, feature_1 double"
    frames = [synthetic(3_500, True, "LONG", 5), synthetic(1_700, True, "BRIEF", 6)]
    config = ExperimentConfig(window_months=3, step_months=3, n_bootstrap=10, embargo_days=85)
    bars = with_position(spark.createDataFrame(pd.concat(frames), schema))
    ready, bounds = wf.prepare(bars, config)
    kinds = F.array(F.lit("a"), F.lit("b"))
    scorer = lambda s: s.withColumn("score", F.col("feature_1")).withColumn("kind", F.explode(kinds))
    out = wf.evaluate(ready, bounds, scorer, config, GRID, ("kind",), ["feature_1"])
    rows = {(r.symbol, r.kind): r for r in out.runs.collect()}
    assert set(rows) == {(s, k) for s in ("LONG", "BRIEF") for k in "ab"}
    assert rows["LONG", "a"].windows_used > 0 and rows["BRIEF", "a"].total_windows >= rows["BRIEF", "a"].windows_skipped > 0
