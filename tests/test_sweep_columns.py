"""Swing and barriers as columns give what one job per setting gives."""

import math
import tempfile
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import trades as tr
from barloom.operators.folds import fold_bounds, fold_windows
from barloom.operators.labels import Barrier, first_touch, label_grid, label_sweep
from barloom.operators.layout import with_position
from barloom.plans import jobs
from barloom.plans.config import ExperimentConfig
from barloom.registry import fixtures as fx
from barloom.sources import tables


def brute_touch(high, low, above, below, swing):
    out = []
    for i in range(len(high)):
        hit = 0
        for j in range(i + 1, min(i + swing, len(high) - 1) + 1):
            if low[j] <= below[i]:
                hit = -1
            elif high[j] >= above[i]:
                hit = 1
            if hit:
                break
        out.append(hit)
    return out


@pytest.mark.parametrize("swing", [1, 2, 3, 7, 8, 20, 60])
def test_first_touch_equals_a_scan(swing):
    draw = np.random.default_rng(swing)
    for n in (1, 2, 5, 200):
        close = 100 + np.cumsum(draw.normal(0, 0.5, n))
        high, low = close + draw.random(n), close - draw.random(n)
        high[draw.random(n) < 0.05] = math.nan
        width = draw.choice([0.5, 2.0, 5.0, math.nan], n)
        assert first_touch(high, low, close + width, close - width, swing).tolist() == brute_touch(high, low, close + width, close - width, swing)


def long_bars(spark, n=300, symbols=("A", "B"), timeframe="1d", hours=24, start="2001-01-01"):
    rows = []
    for k, symbol in enumerate(symbols):
        draw = np.random.default_rng(k)
        close = 100 + np.cumsum(draw.normal(0, 1, n))
        t0 = datetime.fromisoformat(start)
        rows += [(symbol, timeframe, t0 + timedelta(hours=hours * i), float(c + 1), float(c - 1), float(c), None if i < 13 else 2.0) for i, c in enumerate(close)]
    return spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp_ntz, high double, low double, close double, atr_14 double")


def test_label_sweep_equals_label_grid(spark):
    bars = long_bars(spark)
    settings = [Barrier(s, tp, sl) for s in (2, 5, 9) for tp, sl in ((1.0, 1.0), (2.0, 1.5))]
    key = lambda r: (r["symbol"], r["rn"], r["swing"], r["tp"], r["sl"])
    want = {key(r): (r["target"], r["target_ret"], r["label_complete"]) for r in label_grid(bars, settings).collect()}
    got = {key(r): (r["target"], r["target_ret"], r["label_complete"]) for r in label_sweep(bars, settings).collect()}
    assert len(got) == 3600 and got == want


def test_settings_of_another_timeframe_leave_no_row(spark):
    out = label_sweep(long_bars(spark, 30), [Barrier(2), Barrier(3), Barrier(4)], ["1d", "4h", None])
    assert {r["swing"] for r in out.select("swing").distinct().collect()} == {2, 4} and out.count() == 120
    ahead = {r["rn"]: r["close_ahead"] for r in out.filter("symbol = 'A' AND swing = 4").collect()}
    closes = {r["rn"]: r["close"] for r in out.filter("symbol = 'A' AND swing = 4").collect()}
    assert all(ahead[i] == closes.get(i + 4) for i in range(30))


def test_cooldown_and_thresholds_by_column_equal_one_job_each(spark):
    draw = np.random.default_rng(2)
    rows = [(s, i, float(draw.random()), float(draw.normal(0, 0.01))) for s in (3, 7) for i in range(900)]
    scored = spark.createDataFrame(rows, "swing int, pos long, score double, ret double")
    together = tr.cooldown_select(scored.filter("score >= 0.6"), ["swing"], F.col("swing"), ["ret"])
    found = tr.threshold_search(scored, ["swing"], F.col("swing"), F.when(F.col("swing") == 3, F.lit([0.5, 0.7])).otherwise(F.lit([0.55, 0.6, 0.8])), tr.production_min_trades(F.col("swing")))
    found = {r["swing"]: tuple(r)[1:] for r in found.collect()}
    for swing, grid in ((3, [0.5, 0.7]), (7, [0.55, 0.6, 0.8])):
        one = scored.filter(F.col("swing") == swing)
        alone = tr.cooldown_select(one.filter("score >= 0.6"), ["swing"], swing, ["ret"])
        assert sorted(map(tuple, alone.collect())) == sorted(tuple(r) for r in together.filter(F.col("swing") == swing).collect())
        assert found[swing] == tuple(tr.threshold_search(one, ["swing"], swing, grid, tr.production_min_trades(swing)).first())[1:]
    assert tr.naive_trades(scored, F.col("swing")).groupBy("swing").count().orderBy("swing").collect()[1]["count"] == 129


def test_fold_bounds_by_column_equal_one_job_each(spark):
    bars = with_position(long_bars(spark, 1600))
    windows = fold_windows(bars, 6, 6)
    both = fold_bounds(bars, windows.withColumn("swing", F.explode(F.array(F.lit(5), F.lit(20)))), F.col("swing"), run_keys=("swing",))
    for swing in (5, 20):
        want = sorted((tuple(r) for r in fold_bounds(bars, windows, swing).collect()), key=str)
        assert sorted((tuple(r) for r in both.filter(F.col("swing") == swing).drop("swing").collect()), key=str) == want


SLOTS = [(5, 1.0, 1.0, "1d"), (5, 2.0, 1.0, "1d"), (10, 1.5, 1.0, "1d")]
GRIDS = {"binary_homerun": [0.5, 0.7], "multiclass_3": [0.3, 0.5]}
CONFIG = ExperimentConfig(n_bootstrap=20)


def sweep_scorer(slices):
    wide = slices.withColumn("formulation", F.explode(F.lit(list(GRIDS))))
    return wide.withColumn("score", fx.md5_score(*[F.col(c) for c in ("symbol", "rn", "swing", "formulation")]))


def test_a_killed_sweep_resumes_to_the_same_table(spark):
    bars = with_position(long_bars(spark, 1700).filter("atr_14 IS NOT NULL"), last="close")
    slots = spark.createDataFrame(SLOTS, "swing int, tp double, sl double, timeframe string")
    whole = jobs.config_sweep(bars, sweep_scorer, slots, GRIDS, CONFIG)
    # Sums of doubles may come in another order: nine digits.
    rows = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*whole.columns).collect()), key=str)
    want = rows(whole)
    assert len(want) == 12 and all(r[-2] > 0 for r in want)
    folder = tempfile.mkdtemp(prefix="barloom-sweep-") + "/runs"
    # The first batch is written, written once more, then the rest runs in batches of one.
    first = jobs.config_sweep(bars, sweep_scorer, slots.limit(1), GRIDS, CONFIG)
    for _ in range(2):
        tables.write_runs(first, folder, ("timeframe", "swing", "tp", "sl"))
    assert tables.read_runs(spark, folder, jobs.SWEEP_SCHEMA).count() == 4
    out = jobs.run_config_sweep(bars, sweep_scorer, slots, GRIDS, folder, CONFIG, per_batch=1)
    assert rows(out) == want
    again = jobs.run_config_sweep(bars, sweep_scorer, slots, GRIDS, folder, CONFIG)
    assert again.count() == 12


def test_swing_sweep_equals_one_job_each(spark):
    bars = with_position(long_bars(spark, 1200).filter("atr_14 IS NOT NULL"), last="close")
    scorer = lambda df: df.withColumn("score", fx.md5_score(F.col("symbol"), F.col("ts")))
    got = {(r["symbol"], r["swing"]): r for r in jobs.swing_sweep(bars, scorer, (3, 24)).collect()}
    assert len(got) == 4
    for swing in (3, 24):
        labelled = label_grid(bars, [Barrier(swing, 1.5, 1.0)]).drop("swing", "tp", "sl")
        for r in jobs.naive_vs_model(labelled, scorer, swing, 1.5, 1.0, split_swing=24).collect():
            own = got[r["symbol"], swing]
            assert own[f"naive_pf_{r['split']}"] == pytest.approx(r["naive_profit_factor"])
            assert own[f"model_pf_{r['split']}"] == (None if r["model_profit_factor"] is None else pytest.approx(r["model_profit_factor"]))


def test_models_find_an_edge_and_pass_no_noise(spark):
    from barloom.plans import models
    from barloom.plans import walkforward as wf
    from barloom.plans.config import FORMULATIONS

    frames = []
    for symbol, edge in (("EDGE", True), ("NOISE", False)):
        draw = np.random.default_rng(42)
        n = 10_000
        target = draw.choice([-1, 0, 1], n, p=[0.4, 0.2, 0.4])
        close = np.cumprod(1 + draw.normal(0, 0.001, n)) * 10_000
        feature = np.where(target == 1, 1.0, -1.0) + draw.normal(0, 0.1, n) if edge else draw.normal(0, 1, n)
        t0 = datetime(2020, 1, 1)
        frames.append(pd.DataFrame({
            "symbol": symbol, "timeframe": "4h", "ts": [t0 + timedelta(hours=4 * i) for i in range(n)], "close": close, "atr_14": close * 0.02,
            "target": target, "target_ret": np.where(target == 1, 0.03, np.where(target == -1, -0.02, 0.0)), "feature_1": feature,
        }))
    schema = "symbol string, timeframe string, ts timestamp_ntz, close double, atr_14 double, target int, target_ret double, feature_1 double"
    bars = with_position(spark.createDataFrame(pd.concat(frames), schema))
    config = ExperimentConfig(n_bootstrap=100)
    ready, bounds = wf.prepare(bars, config)
    scorer = models.model_scorer(ready, bounds, {"CONTROL": ["feature_1"]}, ("binary_homerun", "regression_return"))
    grids = {name: FORMULATIONS[name].thresholds for name in ("binary_homerun", "regression_return")}
    out = wf.evaluate(ready, bounds, scorer, config, grids, models.RUN_KEYS, ("target_ret", "feature_1"))
    runs = {(r["symbol"], r["formulation"]): r for r in out.runs.collect()}
    for name in grids:
        assert runs["EDGE", name]["passes_gate"] and runs["EDGE", name]["p5"] > 0 and runs["EDGE", name]["pooled_trades"] >= 300
        assert not runs["NOISE", name]["passes_gate"]
