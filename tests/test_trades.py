import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import bootstrap as boot
from barloom.operators import metrics as mx
from barloom.operators import trades as tr


def scored(spark, scores, run="r"):
    rows = [(run, i, float(s), 0.01 * ((i * 7) % 11 - 5)) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "run string, pos long, score double, ret double")


def sequential(scores, thr, swing):
    picks, i = [], 0
    while i < len(scores):
        if scores[i] >= thr:
            picks.append(i)
            i += swing
        else:
            i += 1
    return picks


@pytest.mark.parametrize("density", [0.02, 0.3, 0.9, 1.0])
@pytest.mark.parametrize("swing", [3, 10])
def test_picks_match_the_scan_over_many_blocks(spark, monkeypatch, density, swing):
    monkeypatch.setattr(tr, "FOLD_ROWS", 16)
    monkeypatch.setattr(tr, "FAN", 4)
    rng = random.Random(7)
    scores = [1.0 if rng.random() < density else 0.0 for _ in range(700)]
    scores[200:330] = [0.0] * 130  # whole blocks and block groups without candidates
    df = scored(spark, scores).filter("score >= 0.5")
    got = sorted(r.pos for r in tr.cooldown_select(df, ["run"], swing, ["score"]).collect())
    assert got == sequential(scores, 0.5, swing)


def test_known_bound_skips_composition_with_the_same_result(spark):
    rng = random.Random(1)
    scores = [rng.random() for _ in range(500)]
    df = scored(spark, scores).filter("score >= 0.6")
    got = sorted(r.pos for r in tr.cooldown_select(df, ["run"], 10, []).collect())
    assert got == sequential(scores, 0.6, 10)


def test_naive_counts(spark):
    assert tr.naive_trades(scored(spark, [1.0] * 20), 5).count() == 4
    assert tr.naive_trades(scored(spark, [1.0] * 50), 24).count() == 3


def test_grids():
    assert len(tr.threshold_grid(*tr.BINARY_GRID, inclusive=False)) == 35
    assert [len(tr.threshold_grid(*g)) for g in (tr.BINARY_GRID, tr.MULTICLASS_GRID, tr.REGRESSION_GRID)] == [36, 46, 36]
    assert tr.threshold_grid(*tr.BINARY_GRID)[0] == 0.5


def test_threshold_search_matches_a_loop(spark, monkeypatch):
    monkeypatch.setattr(tr, "FOLD_ROWS", 32)
    rng = random.Random(11)
    scores = [round(rng.random(), 2) for _ in range(400)]
    df = scored(spark, scores)
    rets = [0.01 * ((i * 7) % 11 - 5) for i in range(400)]
    grid = tr.threshold_grid(*tr.BINARY_GRID)
    best = None
    for t in grid:
        picks = sequential(scores, t, 10)
        net = round(sum(rets[i] for i in picks), 12)
        if len(picks) >= 8 and (best is None or net > best[1]):
            best = (t, net, len(picks))
    row = tr.threshold_search(df, ["run"], 10, grid, 8).first()
    assert (row.threshold, round(row.net, 12), row.n_trades) == best


def test_no_threshold_is_null(spark):
    row = tr.threshold_search(scored(spark, [0.05] * 20), ["run"], 5, tr.threshold_grid(*tr.BINARY_GRID), 8).first()
    assert row.threshold is None and row.n_rows == 20
    # Negative thresholds are ordinary values.
    row = tr.threshold_search(scored(spark, [-0.003] * 200), ["run"], 5, tr.threshold_grid(*tr.REGRESSION_GRID), 8).first()
    assert row.threshold == pytest.approx(-0.0035)


def test_drawdown_merges_blocks(spark, monkeypatch):
    monkeypatch.setattr(mx, "FOLD_ROWS", 8)
    rng = random.Random(2)
    rets = [rng.gauss(0.002, 0.05) for _ in range(200)]
    rows = [("r", i, x, max(x, 0.0), max(-x, 0.0)) for i, x in enumerate(rets)]
    row = mx.trade_metrics(spark.createDataFrame(rows, "run string, pos long, ret double, gain double, loss double"), ["run"]).first()
    equity = peak = 1.0
    worst = 0.0
    for x in rets:
        equity *= 1 + x
        peak = max(peak, equity)
        worst = max(worst, (peak - equity) / peak)
    assert row.max_drawdown == pytest.approx(worst)
    assert row.trade_count == 200
    assert row.profit_factor == pytest.approx(sum(r[3] for r in rows) / sum(r[4] for r in rows))


def test_scores_and_gates(spark):
    df = spark.sql("SELECT * FROM VALUES (0.9D, 0.1D, 50L), (1.5D, 0.1D, 50L), (50D, 0D, 20L) t(profit_factor, max_drawdown, trade_count)")
    fit = [r[0] for r in df.select(mx.fitness_score(F.lit(500), F.lit(10.0))).collect()]
    assert fit[0] == -999.0 and fit[1] == pytest.approx(5 * 3.912023005428146) and fit[2] == pytest.approx(900 * 2.995732273553991)
    prod = [r[0] for r in df.select(mx.production_score(30)).collect()]
    assert prod[0] == -9999.0 + 50 and prod[2] == -9999.0 + 20
    gates = spark.sql("SELECT * FROM VALUES (300L, 0.01D), (299L, 0.01D), (400L, 0D), (400L, NULL) t(n, p5)")
    assert [r[0] for r in gates.select(mx.passes_gate(F.col("n"), F.col("p5"))).collect()] == [True, False, False, False]
    sane = spark.sql("SELECT * FROM VALUES (1D, 2D), (0.9D, 2D), (5D, 0D), (5D, -999D) t(a, b)")
    assert [r[0] for r in sane.select(mx.oos_sane(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_payoffs(spark):
    df = spark.sql("SELECT 100D AS close, 2D AS atr_14, t.target, 101D AS x FROM VALUES (1), (-1), (0) t(target)")
    ternary = [r[0] for r in df.select(tr.trade_return(1.5, 1.0, F.col("x"), 0.003)).collect()]
    binary = [r[0] for r in df.select(tr.trade_return(1.5, 1.0, F.col("x"), payoff="binary")).collect()]
    assert ternary == pytest.approx([0.027, -0.023, 0.007]) and binary == pytest.approx([0.03, -0.02, -0.02])
    with pytest.raises(ValueError):
        tr.trade_return(1, 1, F.col("x"), payoff="other")


def block_trades(spark, n=64, edge=0.0):
    t0 = datetime(2024, 1, 1)
    rows = []
    for side in ("model", "naive"):
        for i in range(n):
            ret = (0.02 if i % 2 else -0.02) + (edge if side == "model" else 0.0)
            rows.append(("r", 0, side, t0 + timedelta(hours=i), ret))
    trades = spark.createDataFrame(rows, "run string, fold int, side string, ts timestamp_ntz, ret double")
    windows = spark.createDataFrame([("r", 0, t0, t0 + timedelta(hours=n), 0)], "run string, fold int, start timestamp_ntz, end timestamp_ntz, block0 long")
    return trades, windows


def test_blocks_hold_their_left_edge(spark):
    trades, windows = block_trades(spark)
    got = {r.block: (r.model_trades, r.naive_trades) for r in boot.block_sums(trades, windows, ["run"]).collect()}
    assert got == {b: (8, 8) for b in range(8)}


def test_bootstrap_is_repeatable_and_sees_an_edge(spark):
    trades, windows = block_trades(spark, edge=0.01)
    blocks = boot.block_sums(trades, windows, ["run"])
    one = boot.delta_percentiles(boot.paired_block_bootstrap(blocks, ["run"], 120), ["run"]).first()
    two = boot.delta_percentiles(boot.paired_block_bootstrap(blocks.repartition(3), ["run"], 120), ["run"]).first()
    assert one == two and one.p5 > 0 and one.n_null_iters == 0
    other = boot.delta_percentiles(boot.paired_block_bootstrap(block_sums_odd(spark), ["run"], 60, seed=7), ["run"]).first()
    assert other.n_null_iters >= 0


def block_sums_odd(spark):
    trades, windows = block_trades(spark)
    return boot.block_sums(trades.filter("side = 'naive' OR hour(ts) < 3"), windows, ["run"])


def test_undefined_iterations_remove_the_percentiles(spark):
    trades, windows = block_trades(spark)
    only_naive = boot.block_sums(trades.filter("side = 'naive'"), windows, ["run"])
    row = boot.delta_percentiles(boot.paired_block_bootstrap(only_naive, ["run"], 20), ["run"]).first()
    assert row.n_null_iters == 20 and row.p5 is None


def test_exact_quantiles_of_skewed_groups(spark):
    from barloom.operators.quantiles import exact_quantiles

    rng = random.Random(4)
    groups = {"wide": [rng.lognormvariate(0, 3) for _ in range(900)], "ties": [1.0] * 50 + [2.0] * 7, "one": [5.0],
              "outlier": [float(i) for i in range(800)] + [1e12], "constant": [3.0] * 700}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("one", None)], "k string, v double")
    probs = {"p05": 0.05, "p50": 0.5, "p90": 0.9}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs, accuracy=100).collect()}
    for k, vs in groups.items():
        vs = sorted(vs)
        for name, p in probs.items():
            at = p * (len(vs) - 1)
            lo = int(at)
            expected = vs[lo] + (at - lo) * (vs[min(lo + 1, len(vs) - 1)] - vs[lo])
            assert got[k][name] == pytest.approx(expected)


def test_iid_bootstrap_matches_a_loop(spark):
    import hashlib

    sides = {"model": [0.02, -0.01, 0.03, -0.02, 0.01], "naive": [0.01, -0.02, 0.02]}
    rows = [("r", s, i, x) for s, xs in sides.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "run string, side string, idx long, ret double")
    got = {r.iteration: r.delta for r in boot.iid_bootstrap(df, ["run"], 20).collect()}

    def factor(side, it):
        xs = sides[side]
        drawn = [xs[int(hashlib.md5(f"42|{side}|{it}|{j}".encode()).hexdigest()[:8], 16) % len(xs)] for j in range(len(xs))]
        return sum(x for x in drawn if x > 0) / max(-sum(x for x in drawn if x < 0), 1e-9)

    assert len(got) == 20
    for it, delta in got.items():
        assert delta == pytest.approx(factor("model", it) - factor("naive", it))
