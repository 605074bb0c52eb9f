import math
import tempfile
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from barloom.operators.columns import LABEL_COLS, clean, strategies
from barloom.operators.indicators import technicals
from barloom.operators.labels import Barrier, barrier_labels
from barloom.plans import diagnostics, enrich, jobs, models, sweep
from barloom.plans.dataset import PROFILES, Sources, build_dataset, get_profile
from barloom.streaming.scan import closed_bars, scan_stream


@pytest.fixture
def series(bars):
    close = [100 + 10 * math.sin(i / 5) + (i * 13) % 7 for i in range(200)]
    return bars(close, [c + 2 for c in close], [c - 2 for c in close], volume=[float(1 + i % 9) for i in range(200)])


@pytest.fixture
def sentiment(spark):
    rows = [(datetime(2023, 12, 1) + timedelta(days=i), float(i % 50)) for i in range(80)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, fng_value double")


def test_profiles():
    assert sorted(PROFILES) == ["control", "funding_rate", "onchain_activity", "onchain_fee_pressure", "taker_buy_ratio", "trend_htf"]
    with pytest.raises(ValueError, match="available"):
        get_profile("nope")


def test_control_dataset(series, sentiment):
    df, features = build_dataset(series, Sources(sentiment=sentiment))
    assert len(features) == 14 and not set(features) & {"close", *LABEL_COLS}
    assert df.filter(" OR ".join(f"{c} IS NULL" for c in [*features, "target"])).count() == 0
    assert df.agg(F.min("rn"), F.max("rn"), F.max("n_bars"), F.count(F.lit(1))).first()[:] == (0, 150, 151, 151)


def test_missing_source_is_named(series):
    with pytest.raises(ValueError, match="sentiment"):
        build_dataset(series, Sources())


def test_treatment_is_not_a_control_feature(series, sentiment):
    with_taker = series.withColumn("taker_buy_base_vol", F.col("volume") / 2)
    df, features = build_dataset(with_taker, Sources(sentiment=sentiment), "taker_buy_ratio")
    assert "taker_buy_ratio" in df.columns and "taker_buy_ratio" not in features and "taker_buy_base_vol" not in df.columns


def test_strategies_never_hold_labels(series):
    labelled = clean(barrier_labels(technicals(series)), drop_missing=False)
    sets = {r.name: r.features for r in strategies(labelled, with_sentiment=True).collect()}
    assert len(sets) == 14
    for features in sets.values():
        assert not set(features) & set(LABEL_COLS)
    assert sets["Trend Follower + Sentiment"][:2] == ["dist_ema_50", "adx_14"]


def test_best_swing(spark):
    rows = [("a", 5, 25, 25, 0.1, 0.2), ("a", 7, 25, 25, 0.5, 0.1), ("a", 10, 5, 25, 9.0, 9.0), ("b", 5, 1, 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, swing int, val_trades int, test_trades int, delta_val double, delta_test double")
    assert {r.symbol: r.best_swing for r in sweep.best_swing(df, ["symbol"]).collect()} == {"a": 7, "b": 10}


def test_verdicts(spark):
    rows = [("no", "4h", "x", False), ("one", "4h", "x", True), ("tf", "4h", "x", True), ("tf", "4h", "y", True),
            ("two", "4h", "x", True), ("two", "1h", "y", True)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, formulation string, passes_gate boolean")
    got = {r.symbol: r.verdict for r in sweep.asset_verdict(df).collect()}
    assert got == {"no": "reject", "one": "conditional", "tf": "conditional", "two": "approve"}


def test_live_verdict_counts_weeks(spark):
    day = lambda n: datetime(2024, 3, 31) - timedelta(days=n)
    rows = [(k, day(n), v) for k, weeks in (
        ("pause", (0.5, 0.5, 9.0)), ("monitor", (0.86, 3.0, 3.0)), ("fine", (1.0, 0.1, 3.0)), ("good", (9.0, 9.0, 9.0)), ("gap", (0.5, None, 5.0))
    ) for w, pf in enumerate(weeks) if pf is not None for n, v in ((7 * w, pf), (7 * w + 1, -1.0))]
    trades = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, realized_pnl double")
    bands = trades.select("symbol").distinct().withColumns({"pf_p5": F.lit(1.0), "pf_p95": F.lit(2.0)})
    got = {r.symbol: r.verdict for r in diagnostics.live_verdict(trades, bands, ["symbol"]).collect()}
    assert got == {"pause": "pause", "monitor": "monitor", "fine": "within_expectation", "good": "favorable", "gap": "monitor"}


def test_staircase_tells_whether_time_goes_back(spark):
    rows = [("a", datetime(2024, 1, 1 + i // 6, 4 * (i % 6)), i, 1.0) for i in range(18)] + [("b", datetime(2024, 1, 3 - i), i, 1.0) for i in range(2)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, rn long, v double")
    assert {r.symbol: r.monotonic for r in diagnostics.staircase_check(df, "v").collect()} == {"a": True, "b": False}
    assert "monotonic" not in diagnostics.staircase_check(df.drop("rn"), "v").columns


def test_correlation_without_variance_is_no_error(spark):
    """Constant features, labels and pairs: left out, or NaN before all others."""
    rows = [
        (k, float(i % 5), 5.0, float(i % 7) if i % 3 == 1 else None, int(i % 3 == 1) if k == "a" else 1) for k in ("a", "flat") for i in range(60)
    ]
    df = spark.createDataFrame(rows, "symbol string, varied double, constant double, pairs double, target int")
    features = ["varied", "constant", "pairs"]
    got = diagnostics.feature_target_corr(df, features, k=1).collect()
    x, y = [r[1] for r in rows[:60]], [r[4] for r in rows[:60]]
    mx, my = sum(x) / 60, sum(y) / 60
    expected = sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
    assert [(r.symbol, r.feature, r.is_top, r.is_bottom) for r in got] == [("a", "varied", True, True)]
    assert got[0]["corr"] == pytest.approx(expected, rel=1e-12)
    kept = diagnostics.feature_target_corr(df, features, k=1, undefined=float("nan")).collect()
    assert {(r.symbol, r.feature, math.isnan(r["corr"]), r.is_top, r.is_bottom) for r in kept} == {
        ("a", "pairs", True, True, False), ("a", "varied", False, False, True),
    }


def test_correlation_query_on_constant_columns(spark, tmp_path):
    """Ranges so wide that no barrier is touched: labels are all 0 in one series, and 0 where the index mean is known in another."""
    t0 = datetime(2024, 1, 1)
    values = []
    for h in range(600):
        calm = [float((h * 7) % 13), float((h * 5) % 11)]
        wild = [0.0, 100.0, 50.0 + (h * 7) % 13]
        values += [("view", h, calm), ("error", h, wild), ("purchase", h, (calm if h < 200 else wild) + [55.0] * (h // 24 % 3))]
    rows = [(t0 + timedelta(hours=h, minutes=10 * i + 1), s, v) for s, h, vs in values for i, v in enumerate(vs)]
    events = [(n, ts, n % 9, s, v, '{"k": %d}' % (n % 50)) for n, (ts, s, v) in enumerate(rows)]
    kinds = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(events, kinds).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    columns = "symbol, feature, is_top, is_bottom, corr"
    name = "feature_target_corr"
    expected = db.execute(f"SELECT {columns} FROM ({contract.oracle_sql()[name]})").fetchall()
    got = contract.queries()[name](spark, str(tmp_path)).select(*columns.split(", ")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    undefined = {(r.symbol, r.feature) for r in got if math.isnan(r["corr"])}
    assert undefined == {("purchase", "fng_sma_14"), ("purchase", "fng_vol_14")}
    assert {r.symbol for r in got} == {"purchase", "view"}


def test_taker_ratio_needs_a_finite_value(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", None, 2.0)], "symbol string, volume double, taker_buy_base_vol double")
    with pytest.raises(Exception, match="taker"):
        enrich.add_taker_buy_ratio(df).collect()


def test_live_scan_is_strict(spark, series):
    scored = technicals(series, ["atr_14"]).withColumn("score", F.lit(0.6))
    model = spark.createDataFrame([("BTC_USDT", "4h", "m", 0.6, 1.5, 1.0)], "symbol string, timeframe string, model string, threshold double, tp_multi double, sl_multi double")
    assert jobs.latest_signals(scored, model).count() == 0
    row = jobs.latest_signals(scored, model, strict=False).first()
    assert row.rn == 199 and row.tp == pytest.approx(row.close + 1.5 * row.atr_14)
    nobody = spark.createDataFrame([("ETH_USDT",)], "symbol string")
    assert jobs.latest_signals(scored, model, strict=False, active=nobody).count() == 0


def test_stream_equals_batch(spark, series):
    folder = tempfile.mkdtemp(prefix="barloom-stream-")
    cut = F.col("ts") < F.lit("2024-01-25").cast("timestamp_ntz")
    model = spark.createDataFrame([("BTC_USDT", "4h", "m", 0.5, 1.5, 1.0)], "symbol string, timeframe string, model string, threshold double, tp_multi double, sl_multi double")
    scorer = lambda df: technicals(df, ["atr_14", "obv"]).withColumn("score", F.lit(0.9))
    for part in (series.filter(cut), series.filter(~cut)):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/landing")
        scan_stream(closed_bars(spark, f"{folder}/landing"), f"{folder}/bars", f"{folder}/signals", model, scorer, f"{folder}/ckpt").awaitTermination(120)
    streamed = spark.read.parquet(f"{folder}/signals/batch=1").first()
    batch = jobs.latest_signals(scorer(series), model).first()
    assert (streamed.ts, streamed.obv, streamed.tp) == (batch.ts, batch.obv, pytest.approx(batch.tp))


def test_stream_takes_the_latest_correction(spark, series):
    """A bar that lands again and again: its last version counts, also past the tenth batch."""
    folder = tempfile.mkdtemp(prefix="barloom-stream-")
    model = spark.createDataFrame([("BTC_USDT", "4h", "m", 0.5, 1.5, 1.0)], "symbol string, timeframe string, model string, threshold double, tp_multi double, sl_multi double")
    scorer = lambda df: technicals(df, ["atr_14"]).withColumn("score", F.lit(0.9))
    newest = series.agg(F.max("ts")).first()[0]
    series.coalesce(1).write.parquet(f"{folder}/landing")
    for close in range(12):
        series.filter(F.col("ts") == newest).withColumn("close", F.lit(float(close))).coalesce(1).write.mode("append").parquet(f"{folder}/landing")
        scan_stream(closed_bars(spark, f"{folder}/landing", 1), f"{folder}/bars", f"{folder}/signals", model, scorer, f"{folder}/ckpt").awaitTermination(120)
    assert [spark.read.parquet(f"{folder}/signals/batch={b}").first().close for b in (1, 9, 10, 11, 12)] == [0.0, 8.0, 9.0, 10.0, 11.0]


def test_production_fit_without_holdout_is_stored_and_loaded(spark):
    rows = [("BTC_USDT", "4h", datetime(2024, 1, 1) + timedelta(hours=4 * i), float(i % 10), 1 if i % 10 >= 6 else -1) for i in range(90)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp_ntz, a double, target int")
    fitted = models.production_fit(df, ["a"], models.Hyper(n_trees=3))
    folder = tempfile.mkdtemp(prefix="barloom-bundle-")
    models.save_bundle(fitted, spark.createDataFrame([(0.6, 1.5)], "threshold double, tp_multi double"), folder)
    loaded, metadata = models.load_bundle(spark, folder)
    got = loaded(df).select("ts", "target", "score").collect()
    assert got == fitted(df).select("ts", "target", "score").collect() and metadata.first().threshold == 0.6
    assert min(r.score for r in got if r.target == 1) > max(r.score for r in got if r.target == -1)


def test_models_learn_a_visible_rule(spark):
    rows = [(float(i % 10), float((i * 7) % 5), 1 if i % 10 >= 6 else (-1 if i % 10 < 3 else 0), 0.01 * (i % 10 - 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, target int, target_ret double")
    train, val = df.filter("b <> 3"), df.filter("b = 3")
    for form in ("binary_homerun", "multiclass_3", "regression_return"):
        out = models.fit(train, val, form, ["a", "b"], models.Hyper(n_trees=3))(val)
        hi, lo = (out.filter(c).agg(F.avg("score")).first()[0] for c in ("target = 1", "target <> 1"))
        assert hi > lo
    with pytest.raises(ValueError):
        models.fit(train, val, "other", ["a"])


def test_grid_search_picks_the_best_validation_score(spark, bars):
    n = 2600
    close = [100 + 5 * math.sin(i / 4) for i in range(n)]
    df = technicals(bars(close, [c + 1 for c in close], [c - 1 for c in close]), ["atr_14"]).filter("atr_14 IS NOT NULL")
    df = df.withColumns({"rn": F.col("rn") - 13, "n_bars": F.col("n_bars") - 13})
    scorer = lambda rows: rows.withColumn("score", F.when(F.col("target") == 1, 0.9).otherwise(0.1))
    results, winners = jobs.optimize(df, scorer, [Barrier(5, 1.0, 1.0), Barrier(10, 1.5, 1.0), Barrier(10, 1.0, 1.0)])
    assert results.count() == 3
    win = winners.first()
    assert win.fitness > 0 and win.test_fitness is not None and win.n_valid >= 1


def test_regimes_match_a_loop(spark, bars):
    n, swing = 1500, 5
    close = [100 + 5 * math.sin(i / 4) + (i * 7) % 3 for i in range(n)]
    df = technicals(bars(close, [c + 1 for c in close], [c - 1 for c in close], hours=24, timeframe="1d", start="2000-01-01"), ["atr_14"])
    labelled = barrier_labels(df, Barrier(swing, 1.0, 1.0))
    clean_rows = labelled.filter("atr_14 IS NOT NULL").withColumns({"rn": F.col("rn") - 13, "n_bars": F.col("n_bars") - 13})
    scorer = lambda rows: rows.withColumn("score", F.when(F.pmod(F.dayofyear("ts"), F.lit(3)) == 0, 0.9).otherwise(0.2))
    windows = [("early", "2000-06-01", "2001-03-01"), ("in", "2002-01-01", "2002-12-31"), ("out", "2003-01-01", "2003-12-31"), ("gone", "2010-01-01", "2010-12-31")]
    out = {r.regime: r for r in jobs.regimes(clean_rows, windows, scorer, swing, 1.0, 1.0, "2002-06-01", n_iter=20).collect()}
    costly = {r.regime: r for r in jobs.regimes(clean_rows, windows, scorer, swing, 1.0, 1.0, "2002-06-01", n_iter=5, cost=0.01).collect()}
    assert costly["out"].naive_pf < out["out"].naive_pf and costly["out"].naive_trades == out["out"].naive_trades
    rows = sorted(clean_rows.collect(), key=lambda r: r.ts)
    assert out["early"].status == "insufficient_prior" and out["in"].sample_type == "IN-SAMPLE" and out["in"].p5 is None
    assert out["out"].sample_type == "OOS" and out["out"].p5 is not None
    assert out["gone"].status == "insufficient_data"
    for name, lo, hi in windows[1:3]:
        lo, hi = datetime.fromisoformat(lo), datetime.fromisoformat(hi)
        win = [r for r in rows if lo <= r.ts <= hi]
        assert out[name].n_bars == len(win) and out[name].n_prior == sum(r.ts < lo for r in rows)
        pays = [r.atr_14 / r.close * (1 if r.target == 1 else -1) for r in win]
        fired = [r.ts.timetuple().tm_yday % 3 == 0 for r in win]
        model, i = [], 0
        while i < len(win):
            if fired[i]:
                model.append(pays[i])
                i += swing
            else:
                i += 1
        pf = lambda xs: sum(x for x in xs if x > 0) / max(-sum(x for x in xs if x < 0), 1e-9)
        assert (out[name].model_trades, out[name].naive_trades) == (len(model), len(pays[::swing]))
        assert out[name].model_pf == pytest.approx(pf(model)) and out[name].naive_pf == pytest.approx(pf(pays[::swing]))
        assert out[name].cum_return_pct == pytest.approx(100 * (win[-1].close / win[0].close - 1))
