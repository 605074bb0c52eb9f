"""Composed research jobs. Loops of a research matrix are key columns here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import metrics as mx
from barloom.operators import trades as tr
from barloom.operators.bootstrap import delta_percentiles, iid_bootstrap
from barloom.operators.labels import Barrier, label_sweep
from barloom.operators.layout import with_position
from barloom.operators.quantiles import exact_quantiles
from barloom.operators.sizing import barrier_prices
from barloom.operators.splits import bars_per_trade, min_val_trades, split_bounds, split_sizes
from barloom.plans.diagnostics import precision, regime_stats
from barloom.plans.config import ExperimentConfig
from barloom.plans.sweep import SLOT
from barloom.plans.walkforward import Scorer, evaluate, prepare_sweep
from barloom.schemas import SERIES_KEYS
from barloom.session import cut_lineage
from barloom.sources.tables import latest_bar, pending, read_runs, write_runs


def run_metrics(
    scored: DataFrame, keys: Sequence[str], swing: Column | int, threshold: Column | None, ret: str = "ret"
) -> DataFrame:
    """Trade metrics per run: of the model at ``threshold``, or naive (every bar) when None."""
    gain, loss = tr.gain_and_loss(F.col(ret), F.col("target"))
    rows = scored.withColumns({"gain": gain, "loss": loss})
    if threshold is None:
        picked = tr.naive_trades(rows, swing)
    else:
        picked = tr.cooldown_select(rows.filter(F.col("score") >= threshold), keys, swing, [ret, "gain", "loss"])
    return mx.trade_metrics(picked, keys, ret=ret)


def split_positions(
    labelled: DataFrame, swing: Column | int, embargo: Column | int, split_swing: Column | int | None = None,
    swings: Sequence[int] | None = None, closes: DataFrame | None = None,
) -> DataFrame:
    """Bars with their split, position in it, and exit close inside it.

    Where the splits lie is a small table, one row per series and swing. ``swings`` lists the values of ``swing`` if that is a column of
    ``labelled`` (rows of ``label_sweep``, which bring their ``close_ahead``). ``closes``, the bars before labelling, are looked up for
    the last close of each split; they default to ``labelled``.
    """
    if "close_ahead" not in labelled.columns:
        labelled = tr.with_exit_close(labelled if "rn" in labelled.columns else with_position(labelled), swing, SERIES_KEYS)
    closes = (labelled if closes is None else closes).select(*SERIES_KEYS, "rn", "n_bars", "close")
    series = closes.groupBy(*SERIES_KEYS).agg(F.max("n_bars").alias("n_bars"))
    keys = [*SERIES_KEYS, *(["swing"] if swings else [])]
    if swings:
        series = series.withColumn("swing", F.explode(F.array(*[F.lit(s) for s in sorted(set(swings))])))
    sized = split_bounds(split_sizes(series, swing if split_swing is None else split_swing, embargo), embargo).filter("n_train IS NOT NULL")
    parts = [("train", F.lit(0).cast("long"), F.col("n_train")), ("val", F.col("val_lo"), F.col("val_hi")), ("test", F.col("test_lo"), F.col("test_hi"))]
    ranges = sized.select(*keys, F.explode(F.array(*[F.struct(F.lit(p).alias("split"), lo.alias("lo"), hi.alias("hi")) for p, lo, hi in parts])).alias("_r"))
    ranges = ranges.select(*keys, "_r.*").withColumn("rn", F.col("hi") - 1).join(closes.drop("n_bars"), [*SERIES_KEYS, "rn"])
    bounds = ranges.groupBy(*keys).agg(F.collect_list(F.struct("split", "lo", "hi", F.col("close").alias("last"))).alias("_ranges"))
    mine = F.get(F.filter("_ranges", lambda r: (F.col("rn") >= r["lo"]) & (F.col("rn") < r["hi"])), F.lit(0))
    placed = labelled.join(bounds, keys).withColumn("_r", mine).filter("_r IS NOT NULL")
    inside = F.when(F.col("rn") + swing < F.col("_r.hi"), F.col("close_ahead"))
    return placed.withColumns(
        {"split": F.col("_r.split"), "pos": F.col("rn") - F.col("_r.lo"), "exit_close": F.coalesce(inside, F.col("_r.last"))}
    ).drop("close_ahead", "_ranges", "_r")


def naive_vs_model(
    labelled: DataFrame, scorer: Scorer, swing: Column | int, tp: float, sl: float, embargo: Column | int | None = None,
    split_swing: int | None = None, cost: float = 0.0, swings: Sequence[int] | None = None, closes: DataFrame | None = None,
) -> DataFrame:
    """Naive and model metrics on validation and test, threshold found on validation.

    One row per series and split, and per swing if ``swings`` lists the values of the column ``swing``; model columns are NULL
    without a threshold. ``signals``, ``hits`` and ``precision`` count
    every bar that reaches the threshold.
    """
    run = [*SERIES_KEYS, *(["swing"] if swings else [])]
    placed = split_positions(labelled, swing, swing if embargo is None else embargo, split_swing, swings, closes)
    ret = tr.trade_return(tp, sl, F.col("exit_close"), cost)
    rows = scorer(placed.filter("split IN ('val', 'test')")).withColumn("ret", ret)
    scored = cut_lineage(rows.select(*run, "split", "pos", "score", "target", "ret"))
    found = tr.threshold_search(
        scored.filter("split = 'val'"), run, swing,
        tr.threshold_grid(*tr.BINARY_GRID, inclusive=False), tr.production_min_trades(swing),
    )
    found = cut_lineage(found.select(*run, "threshold"))
    keys = [*run, "split"]
    naive = run_metrics(scored, keys, swing, None)
    model = run_metrics(scored.join(found, run), keys, swing, F.col("threshold"))
    columns = ("trade_count", "gross_profit", "gross_loss", "profit_factor", "max_drawdown")
    n = naive.select(*keys, *[F.col(c).alias(f"naive_{c}") for c in columns])
    m = model.select(*keys, *[F.col(c).alias(f"model_{c}") for c in columns])
    fired = scored.join(found, run).withColumn("signal", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)))
    return (
        n.join(found, run, "left").join(m, keys, "left").join(precision(fired, keys), keys, "left")
        .withColumn("delta", F.col("model_profit_factor") - F.col("naive_profit_factor"))
    )


def swing_sweep(
    bars: DataFrame, scorer: Scorer, swings: Sequence[int], tp: float = 1.5, sl: float = 1.0, cost: float = 0.0
) -> DataFrame:
    """Naive against model for every swing: one row per series and swing.

    Bars carry ``atr_14`` and have no missing rows. The swing is a run key: one plan for all swings.
    """
    base = cut_lineage(bars if "last_close" in bars.columns else with_position(bars.drop("rn", "n_bars"), last="close"))
    labelled = label_sweep(base, [Barrier(s, tp, sl) for s in swings]).drop("tp", "sl")
    rows = naive_vs_model(labelled, scorer, F.col("swing"), tp, sl, split_swing=max(swings), cost=cost, swings=swings, closes=base)
    return rows.groupBy(*SERIES_KEYS, "swing").agg(
        *[
            F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{alias}_{s}")
            for s in ("val", "test")
            for c, alias in (("delta", "delta"), ("model_profit_factor", "model_pf"), ("naive_profit_factor", "naive_pf"))
        ],
        *[F.max(F.when(F.col("split") == s, F.col("model_trade_count"))).alias(f"{s}_trades") for s in ("val", "test")],
    )


def regimes(
    labelled: DataFrame, windows: Sequence[tuple[str, str, str]], scorer: Scorer, swing: int, tp: float, sl: float, in_sample_end: str,
    payoff: str = "binary", n_iter: int = 1000, seed: int = 42, min_bars: int = 200, min_prior: int = 500, min_trades: int = 20,
    cost: float = 0.0,
) -> DataFrame:
    """Model against naive per market regime, with a per-trade bootstrap out of sample.

    ``windows`` lists ``(regime, start, end)``, both ends included. The threshold comes from
    the last 15 % (at least 200 bars) before the regime. Returns one row per series
    and regime; ``status`` tells why a regime was not evaluated. ``cost`` is taken off every return.
    """
    keys = [*SERIES_KEYS, "regime"]
    base = cut_lineage(labelled)
    ntz = lambda text: F.lit(text).cast("timestamp_ntz")
    options = F.array(
        *[F.struct(F.lit(name).alias("regime"), ntz(lo).alias("start"), ntz(hi).alias("end")) for name, lo, hi in windows]
    )
    # A bar goes to each regime it belongs to or precedes.
    mine = F.filter(options, lambda w: w["end"] >= F.col("ts"))
    tagged = base.withColumn("_w", F.explode(mine)).select(*base.columns, "_w.*")
    sample = F.when(F.col("start") <= ntz(in_sample_end), "IN-SAMPLE").otherwise("OOS")
    tagged = tagged.withColumn("sample_type", sample)
    sizes = tagged.groupBy(*keys, "sample_type").agg(
        F.count_if(F.col("ts") >= F.col("start")).alias("n_bars"), F.count_if(F.col("ts") < F.col("start")).alias("n_prior")
    )
    status = F.when(F.col("n_bars") < min_bars, "insufficient_data").when(F.col("n_prior") < min_prior, "insufficient_prior")
    sizes = sizes.withColumn("status", status).withColumn("n_val", F.greatest(F.lit(200), F.floor(F.col("n_prior") * 0.15)))
    usable = sizes.filter("status IS NULL").select(*keys, "sample_type", "n_prior", "n_val")
    rows = tagged.drop("sample_type", "n_bars", "last_close").join(usable, keys)
    part = (
        F.when(F.col("ts") >= F.col("start"), "window")
        .when(F.col("rn") >= F.col("n_prior") - F.col("n_val"), "val")
    )
    rows = rows.withColumn("part", part).filter("part IS NOT NULL").drop("start", "end", "n_prior", "n_val", "rn")
    run = [*keys, "part"]
    placed = with_position(rows, run, name="pos", last="close")
    placed = tr.with_exit_close(placed, swing, run, "pos").withColumn("exit_close", F.coalesce("close_ahead", "last_close"))
    scored = cut_lineage(
        scorer(placed).withColumns(
            {
                "ret": tr.trade_return(tp, sl, F.col("exit_close"), cost, payoff),
                "ret_val": tr.trade_return(tp, sl, F.col("exit_close"), cost),
            }
        )
    )
    found = tr.threshold_search(
        scored.filter("part = 'val'"), keys, swing, tr.threshold_grid(*tr.BINARY_GRID, inclusive=False),
        tr.production_min_trades(swing), ret="ret_val",
    ).select(*keys, "threshold")
    found = cut_lineage(found)
    window = scored.filter("part = 'window'").join(found.filter("threshold IS NOT NULL"), keys)
    model = tr.cooldown_select(window.filter("score >= threshold"), keys, swing, ["ret"])
    naive = tr.naive_trades(window, swing).select(*keys, "pos", "ret")
    trades = cut_lineage(
        model.withColumn("side", F.lit("model")).unionByName(naive.withColumn("side", F.lit("naive")))
    )
    sums = _side_factors(trades, keys)
    enough = (F.col("model_trades") >= min_trades) & (F.col("naive_trades") >= min_trades)
    eligible = sums.join(usable.select(*keys, "sample_type"), keys).filter((F.col("sample_type") == "OOS") & enough).select(*keys)
    cuts = _trade_bootstrap(trades.join(eligible, keys), keys, n_iter, seed)
    market = regime_stats(
        tagged.filter("ts >= start").select(*SERIES_KEYS, "regime", "ts", "rn", "close"), keys
    ).select(*keys, "cum_return_pct", "ret_std_pct")
    out = sizes.select(*keys, "sample_type", "n_bars", "n_prior", "status")
    out = out.join(found, keys, "left").join(sums, keys, "left").join(cuts, keys, "left").join(market, keys, "left")
    failed = F.col("status").isNull() & F.col("threshold").isNull()
    return out.withColumn("status", F.when(failed, "threshold_failed").otherwise(F.col("status")))


def _side_factors(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trades and profit factor of both sides, by the sign of the returns, and their difference."""
    r = F.col("ret")
    sums = trades.groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when((F.col("side") == s) & wins, F.abs(r))), F.lit(0.0)).alias(f"_{s}_{n}")
            for s in ("model", "naive") for n, wins in (("gain", r > 0), ("loss", r < 0))
        ],
        *[F.count_if(F.col("side") == s).alias(f"{s}_trades") for s in ("model", "naive")],
    )
    pf = {s: mx.profit_factor(F.col(f"_{s}_gain"), F.col(f"_{s}_loss"), F.col(f"{s}_trades")) for s in ("model", "naive")}
    return sums.select(
        *keys, "model_trades", "naive_trades", pf["model"].alias("model_pf"), pf["naive"].alias("naive_pf"),
        (pf["model"] - pf["naive"]).alias("delta"),
    )


def _trade_bootstrap(trades: DataFrame, keys: Sequence[str], n_iter: int, seed: int) -> DataFrame:
    """Percentiles of the per-trade bootstrap; the trades of a side are numbered in order."""
    indexed = with_position(trades.withColumn("_one", F.lit(0)), [*keys, "side"], "pos", F.expr("pos div 262144"), "idx")
    return delta_percentiles(iid_bootstrap(indexed, keys, n_iter, seed), keys).select(*keys, "p5", "p50", "p95")


#: Quantiles of scores that a comparison of formulations reports, beside the maximum.
SCORE_QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def compare_formulations(
    labelled: DataFrame, scorer: Scorer, swing: int, tp: float, sl: float, thresholds: Mapping[str, Sequence[float]], cost: float = 0.0,
    n_iter: int = 1000, seed: int = 42, min_trades: int = 20,
) -> DataFrame:
    """Formulations side by side on validation and test, each with its own thresholds.

    One row per series, formulation and split: threshold (from validation), trades and profit factor against naive, quantiles of the scores, and
    percentiles of the per-trade bootstrap where both sides have ``min_trades``. The scorer adds ``formulation`` and ``score``.
    """
    run, keys = [*SERIES_KEYS, "formulation"], [*SERIES_KEYS, "formulation", "split"]
    placed = split_positions(labelled, swing, swing).filter("split IN ('val', 'test')")
    rows = scorer(placed).withColumn("ret", tr.trade_return(tp, sl, F.col("exit_close"), cost))
    scored = cut_lineage(rows.select(*keys, "pos", "score", "ret"))
    grid = F.coalesce(*[F.when(F.col("formulation") == name, F.lit([float(x) for x in own])) for name, own in thresholds.items()])
    found = tr.threshold_search(scored.filter("split = 'val'"), run, swing, grid, tr.production_min_trades(swing))
    found = cut_lineage(found.select(*run, "threshold"))
    known = scored.join(found.filter("threshold IS NOT NULL"), run)
    model = tr.cooldown_select(known.filter("score >= threshold"), keys, swing, ["ret"])
    naive = tr.naive_trades(known, swing).select(*keys, "pos", "ret")
    trades = cut_lineage(model.withColumn("side", F.lit("model")).unionByName(naive.withColumn("side", F.lit("naive"))))
    sums = cut_lineage(_side_factors(trades, keys))
    enough = sums.filter((F.col("model_trades") >= min_trades) & (F.col("naive_trades") >= min_trades)).select(*keys)
    cuts = _trade_bootstrap(trades.join(enough, keys), keys, n_iter, seed)
    quantiles = exact_quantiles(scored, keys, "score", SCORE_QUANTILES)
    quantiles = quantiles.select(*keys, *[F.col(c).alias(f"score_{c}") for c in SCORE_QUANTILES])
    most = scored.groupBy(*keys).agg(F.max("score").alias("score_max"))
    return most.join(quantiles, keys).join(found, run, "left").join(sums, keys, "left").join(cuts, keys, "left")


def optimize(
    bars: DataFrame, scorer: Scorer, barriers: Sequence[Barrier], cost: float = 0.0, run_keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Grid search per series: all configurations on validation, the winner also on test.

    ``scorer`` may add key columns (``run_keys``: strategy, hyper-parameters). Splits are
    sized for the largest swing. Swing and barriers are run keys: one plan for all of them. Returns the
    validation results of every configuration and one winner row per series with its test score and verdict.
    """
    largest, swing = max(b.swing for b in barriers), F.col("swing")
    config = ("swing", "tp", "sl", *run_keys)
    keys = [*SERIES_KEYS, *config]
    base = cut_lineage(bars if "last_close" in bars.columns else with_position(bars.drop("rn", "n_bars"), last="close"))
    swings = [b.swing for b in barriers]
    placed = split_positions(label_sweep(base, barriers), swing, swing, largest, swings, base).filter("split IN ('val', 'test')")
    ret = tr.trade_return(F.col("tp"), F.col("sl"), F.col("exit_close"), cost)
    scored = cut_lineage(scorer(placed).withColumn("ret", ret).select(*keys, "split", "pos", "score", "target", "ret"))
    val = scored.filter("split = 'val'")
    grid = tr.threshold_grid(*tr.BINARY_GRID, inclusive=False)
    found = tr.threshold_search(val, keys, swing, grid, tr.production_min_trades(swing))
    found = cut_lineage(found.filter("threshold IS NOT NULL").select(*keys, "threshold", "n_rows"))
    results = cut_lineage(_config_metrics(val, found, keys, swing))

    floor = min_val_trades(F.col("n_rows"), largest, bars_per_trade(F.col("timeframe")))
    winners = cut_lineage(rank_configs(results, SERIES_KEYS, floor, config))
    test = scored.filter("split = 'test'").join(winners.select(*keys), keys, "left_semi")
    sizes = test.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    audits = _config_metrics(test, winners.select(*keys, "threshold").join(sizes, keys), keys, swing)
    audits = audits.select(*SERIES_KEYS, F.col("fitness").alias("test_fitness"), F.col("trade_count").alias("test_trades"))
    verdict = winners.join(audits, list(SERIES_KEYS), "left")
    return results, verdict.withColumn("oos_sane", mx.oos_sane(F.col("test_fitness"), F.col("fitness")))


def _config_metrics(rows: DataFrame, found: DataFrame, keys: Sequence[str], swing: Column) -> DataFrame:
    """Reported metrics per configuration: score from exact values, the rest rounded."""
    fired = rows.join(found.select(*keys, "threshold"), list(keys))
    exact = run_metrics(fired, keys, swing, F.col("threshold"))
    exact = exact.join(found, list(keys))
    return exact.select(
        *keys,
        "threshold",
        "n_rows",
        "trade_count",
        F.round("gross_profit", 6).alias("gross_profit"),
        F.round("gross_loss", 6).alias("gross_loss"),
        F.round("profit_factor", 4).alias("profit_factor"),
        F.round("max_drawdown", 4).alias("max_drawdown"),
        F.round(mx.fitness_score(F.col("n_rows"), swing.cast("double")), 6).alias("fitness"),
    )


SWEEP_RUN = ("swing", "tp", "sl", "formulation")


def config_sweep(
    bars: DataFrame, scorer: Scorer, slots: DataFrame, thresholds: Mapping[str, Sequence[float]], config: ExperimentConfig = ExperimentConfig()
) -> DataFrame:
    """Walk-forward of every slot (swing, tp, sl, timeframe) under every formulation of ``thresholds``, in one job.

    ``bars`` are clean, with ``atr_14`` and positions; the scorer adds ``formulation`` and ``score``. One row per symbol and run, also for
    runs without usable windows.
    """
    rows = [tuple(r) for r in slots.select("swing", "tp", "sl", "timeframe").collect()]
    ready, bounds = prepare_sweep(bars, [Barrier(*r[:3]) for r in rows], config, [r[3] for r in rows])
    runs = slots.withColumn("formulation", F.explode(F.array(*[F.lit(name) for name in thresholds])))
    out = evaluate(ready, bounds, scorer, config, thresholds, SWEEP_RUN, runs=runs).runs
    return out.select(
        *SERIES_KEYS, *SWEEP_RUN, F.round(F.col("tp") / F.col("sl"), 3).alias("rr"), "p5", "p95", (F.col("p95") - F.col("p5")).alias("ci_width"),
        "pooled_trades", "passes_gate", "windows_used", "windows_delta_gt_0",
    )


def run_config_sweep(
    bars: DataFrame, scorer: Scorer, slots: DataFrame, thresholds: Mapping[str, Sequence[float]], path: str,
    config: ExperimentConfig = ExperimentConfig(), per_batch: int = 16,
) -> DataFrame:
    """``config_sweep`` into a table that can be resumed: slots without results run in batches, each written as a whole.

    A batch that is killed leaves nothing or is run again; writing a slot twice leaves one copy.
    """
    spark, keys = bars.sparkSession, ("timeframe", "swing", "tp", "sl")
    base = cut_lineage(bars)
    done = read_runs(spark, path, SWEEP_SCHEMA)
    todo = [tuple(r) for r in pending(slots, done.select(*keys).distinct(), keys).select("swing", "tp", "sl", "timeframe").orderBy(*keys).collect()]
    for at in range(0, len(todo), per_batch):
        batch = spark.createDataFrame(todo[at : at + per_batch], SLOT)
        write_runs(config_sweep(base, scorer, batch, thresholds, config), path, keys)
    return read_runs(spark, path, SWEEP_SCHEMA)


SWEEP_SCHEMA = (
    "symbol string, timeframe string, swing int, tp double, sl double, formulation string, rr double, p5 double, p95 double, ci_width double, "
    "pooled_trades long, passes_gate boolean, windows_used long, windows_delta_gt_0 long"
)


def rank_configs(
    results: DataFrame, keys: Sequence[str], min_trades: Column | int, config: Sequence[str]
) -> DataFrame:
    """Winner per key by production score, equal scores to the first configuration.

    Configurations at the fitness sentinel (no edge) are out.
    """
    valid = results.filter(F.col("fitness") != -999.0).withColumn("production", mx.production_score(min_trades))
    rest = [c for c in valid.columns if c not in keys]
    # min_by over (score descending, configuration): combines before the shuffle.
    order = F.struct((-F.round("production", 9)).alias("_p"), *config)
    best = valid.groupBy(*list(keys)).agg(F.count(F.lit(1)).alias("n_valid"), F.min_by(F.struct(*rest), order).alias("_w"))
    return best.select(*list(keys), "n_valid", "_w.*")


def latest_signals(
    scored: DataFrame, models: DataFrame, strict: bool = True, active: DataFrame | None = None
) -> DataFrame:
    """Signals of the newest bar of every series under every model of its symbol.

    ``scored`` has bars with ``score``; ``models`` one row per (symbol, timeframe, model) with
    ``threshold, tp_multi, sl_multi``. Live scans want a score above the threshold,
    backtests also take equality.
    """
    if active is not None:
        scored = scored.join(active.select("symbol"), "symbol", "left_semi")
    newest = latest_bar(scored).join(models, list(SERIES_KEYS))
    fires = F.col("score") > F.col("threshold") if strict else F.col("score") >= F.col("threshold")
    return barrier_prices(newest.filter(fires), F.col("tp_multi"), F.col("sl_multi"))


def oos_signals(scored: DataFrame, threshold: Column | float, share: float = 0.8) -> DataFrame:
    """Signal flag on the last ``1 - share`` of every series (missing scores give no signal)."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    placed = scored if "n_bars" in scored.columns else with_position(scored)
    kept = placed.filter(F.col("rn") >= F.floor(F.col("n_bars") * share))
    return kept.withColumn("signal", F.coalesce(F.col("score") >= threshold, F.lit(False)))


def recent_signal_count(scored: DataFrame, keys: Sequence[str], n: int = 60, pos: str = "rn") -> DataFrame:
    """Signals among the last ``n`` bars of every run."""
    return scored.filter(F.col(pos) >= F.col("n_bars") - n).groupBy(*list(keys)).agg(F.count_if("signal").alias("recent_signals"))


def label_reconciliation(labelled: DataFrame, swing: int, tp: float, sl: float, embargo: int) -> DataFrame:
    """Naive profit factor under old and new labels and payoffs, per split.

    ``labelled`` has ``target`` (barrier label) and ``target_extrema`` (older binary label).
    """
    placed = cut_lineage(split_positions(labelled, swing, embargo).filter("split IN ('val', 'test')"))
    keys = [*SERIES_KEYS, "split", "regime"]
    exit_close = F.col("exit_close")
    cases = {
        "old_label_old_payoff": ("target_extrema", "binary"),
        "old_label_new_payoff": ("target_extrema", "ternary"),
        "new_label_new_payoff": ("target", "ternary"),
    }
    out = None
    for name, (label, payoff) in cases.items():
        rows = placed.withColumn("target", F.col(label)).withColumn("regime", F.lit(name))
        rows = tr.naive_trades(rows, swing).withColumn("ret", tr.trade_return(tp, sl, exit_close, payoff=payoff))
        as_stop = F.when((F.col("target") != 1) & F.lit(payoff == "binary"), -1).otherwise(F.col("target"))
        gain, loss = tr.gain_and_loss(F.col("ret"), as_stop)
        one = rows.withColumns({"gain": gain, "loss": loss}).select(*keys, "pos", "ret", "gain", "loss")
        out = one if out is None else out.unionByName(one)
    return mx.trade_metrics(out, keys)
