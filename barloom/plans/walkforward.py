"""Expanding walk-forward evaluation of a score, all runs and folds in one job.

A *run* is a series plus whatever other key columns the scores carry (formulation,
variant, seed, ...). The model stays outside: a scorer turns fold slices into the
same slices with a ``score`` column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import bootstrap as boot
from barloom.operators.folds import fold_bounds, fold_slices, fold_windows, number_used_blocks
from barloom.operators.labels import Barrier, label_sweep
from barloom.operators.metrics import passes_gate, profit_factor, signed_sums
from barloom.operators.splits import VAL_TRADES_FLOOR
from barloom.operators.trades import cooldown_select, naive_trades, threshold_search, trade_return, with_exit_close
from barloom.plans.config import ExperimentConfig
from barloom.schemas import SERIES_KEYS
from barloom.session import cut_lineage

Scorer = Callable[[DataFrame], DataFrame]


@dataclass
class WalkForward:
    """Lazy result tables of one evaluation."""

    bounds: DataFrame  # one row per series and fold
    thresholds: DataFrame  # one row per run and usable fold
    trades: DataFrame  # out-of-sample trades of both sides
    windows: DataFrame  # one row per run and fold, skipped ones included
    runs: DataFrame  # one row per run: pooled metrics, percentiles, gate


def prepare(bars: DataFrame, config: ExperimentConfig) -> tuple[DataFrame, DataFrame]:
    """Bars with look-ahead exits, and the fold bounds of every series.

    Both are written once: every fold, run and formulation reads them again.
    """
    ready = cut_lineage(with_exit_close(bars, config.swing_period, SERIES_KEYS))
    windows = fold_windows(ready, config.window_months, config.step_months)
    bounds = fold_bounds(ready, windows, config.swing_period, config.embargo_days, config.embargo_bars)
    return ready, cut_lineage(bounds)


def prepare_sweep(bars: DataFrame, barriers: Sequence[Barrier], config: ExperimentConfig, timeframes: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Bars labelled for every setting, and the fold bounds of every series and swing.

    A setting counts for the series of its timeframe. Bounds depend on the swing alone, so they are found once for each.
    """
    ready = cut_lineage(label_sweep(bars, barriers, timeframes))
    windows = fold_windows(bars, config.window_months, config.step_months)
    swings = F.array(*[F.lit(s) for s in sorted({b.swing for b in barriers})])
    bounds = fold_bounds(
        bars, windows.withColumn("swing", F.explode(swings)), F.col("swing"), config.embargo_days, config.embargo_bars, run_keys=("swing",)
    )
    return ready, cut_lineage(bounds)


def evaluate(
    ready: DataFrame,
    bounds: DataFrame,
    scorer: Scorer,
    config: ExperimentConfig,
    thresholds: Sequence[float] | Mapping[str, Sequence[float]],
    run_keys: Sequence[str] = (),
    columns: Sequence[str] = (),
    runs: DataFrame | None = None,
) -> WalkForward:
    """Threshold on validation, trades and naive trades out of sample, bootstrap, gate.

    ``thresholds`` is one grid, or one per value of a ``formulation`` run key.
    ``bounds`` is a written table (see ``prepare``). If ``swing``, ``tp`` and ``sl`` are run keys, they are columns of ``ready`` and
    replace the settings of ``config``; ``bounds`` then has a row per swing. ``runs`` lists the combinations of run keys
    that exist (with ``timeframe``, if it decides); without it all combinations that occur are taken for all series.
    """
    keys = [*SERIES_KEYS, *run_keys]
    run = [*keys, "fold"]
    swept = "swing" in run_keys
    swing: Column | int = F.col("swing") if swept else config.swing_period
    tp, sl = (F.col("tp"), F.col("sl")) if swept else (config.tp_multi, config.sl_multi)
    base = ("ts", "close", "atr_14", "target", "close_ahead", *(("tp", "sl") if swept else ()))
    slices = fold_slices(ready, bounds, ("val", "oos"), (*base, *columns), swing, [*SERIES_KEYS, *(("swing",) if swept else ())])
    ret = trade_return(tp, sl, F.col("exit_close"), config.cost)
    # Read for the thresholds, the sizes of the runs and both sides out of sample.
    scored = cut_lineage(scorer(slices).select(*run, "part", "pos", "ts", "score", ret.alias("ret")))

    val = scored.filter("part = 'val'")
    grid: Column | Sequence[float] = thresholds
    if isinstance(thresholds, Mapping):
        grid = F.coalesce(*[F.when(F.col("formulation") == name, F.lit([float(t) for t in own])) for name, own in thresholds.items()])
    chosen = cut_lineage(threshold_search(val, run, swing, grid, VAL_TRADES_FLOOR).select(*run, "threshold"))

    used = chosen.filter("threshold IS NOT NULL")
    oos = scored.filter("part = 'oos'").join(used, run)
    model = cooldown_select(oos.filter("score >= threshold"), run, swing, ["ts", "ret"])
    naive = naive_trades(oos, swing)
    trades = cut_lineage(
        model.select(*run, F.lit("model").alias("side"), "pos", "ts", "ret").unionByName(
            naive.select(*run, F.lit("naive").alias("side"), "pos", "ts", "ret")
        )
    )

    windows = _window_table(bounds, chosen, trades, keys, runs)
    ranges = number_used_blocks(
        windows.filter("skipped_reason IS NULL").select(*run, "start", "end"), keys, config.n_blocks
    )
    blocks = boot.block_sums(trades, ranges, keys, n_blocks=config.n_blocks)
    deltas = boot.paired_block_bootstrap(blocks, keys, config.n_bootstrap, config.random_state)
    runs = _run_table(windows, boot.delta_percentiles(deltas, keys), keys)
    return WalkForward(bounds, chosen, trades, windows, runs)


def _window_table(bounds: DataFrame, chosen: DataFrame, trades: DataFrame, keys: Sequence[str], runs: DataFrame | None = None) -> DataFrame:
    run = [*keys, "fold"]
    own = [k for k in keys if k in bounds.columns]
    extra = [k for k in keys if k not in own]
    r, is_model = F.col("ret"), F.col("side") == "model"
    stats = trades.groupBy(*run).agg(
        F.coalesce(F.sum(F.when(is_model, r)), F.lit(0.0)).alias("cum_ret"),
        F.coalesce(F.stddev_pop(F.when(is_model, r)), F.lit(0.0)).alias("vol"),
        *[
            F.coalesce(F.sum(F.when((F.col("side") == side) & wins, F.abs(r))), F.lit(0.0)).alias(f"_{side}_{name}")
            for side in ("model", "naive")
            for name, wins in (("gain", r > 0), ("loss", r < 0))
        ],
        F.count_if(is_model).alias("model_trade_count"),
        F.count_if(~is_model).alias("naive_trade_count"),
    )
    table = bounds.select(*own, "fold", "start", "end", "skipped_reason")
    if runs is not None:
        table = table.join(F.broadcast(runs), [c for c in runs.columns if c in own])
    elif extra:
        # Folds skipped for lack of data have no slices: they get one row for each of
        # the few combinations of formulation, variant, ... that occur.
        combinations = chosen.select(*extra).distinct().agg(F.collect_list(F.struct(*extra))).scalar()
        table = table.withColumn("_r", F.explode(combinations)).select(*table.columns, "_r.*")
    table = table.join(chosen, run, "left").join(stats, run, "left")
    reason = F.coalesce(
        "skipped_reason", F.when(F.col("threshold").isNull(), "threshold_failed")
    )
    table = table.withColumn("skipped_reason", reason)
    skipped = F.col("skipped_reason").isNotNull()
    pf = {
        side: profit_factor(F.col(f"_{side}_gain"), F.col(f"_{side}_loss"), F.col(f"{side}_trade_count"))
        for side in ("model", "naive")
    }
    zero = F.lit(0.0)
    return table.select(
        *run,
        "start",
        "end",
        *[F.when(skipped, zero).otherwise(F.col(c)).alias(c) for c in ("cum_ret", "vol", "threshold")],
        F.when(skipped, zero).otherwise(pf["model"]).alias("model_pf"),
        F.when(skipped, zero).otherwise(pf["naive"]).alias("naive_pf"),
        # Equal trades may be summed in another order: differences below 1e-12 are none.
        F.when(skipped, zero).otherwise(F.round(pf["model"] - pf["naive"], 12)).alias("delta"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("model_trade_count", "naive_trade_count")],
        "skipped_reason",
        *[F.coalesce(c, zero).alias(c) for c in ("_model_gain", "_model_loss")],
    )


def _run_table(windows: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    used = F.col("skipped_reason").isNull()
    pooled = windows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_windows"),
        F.count_if(used).alias("windows_used"),
        F.count_if(used & (F.col("model_pf") > 1.0)).alias("windows_pf_gt_1"),
        F.count_if(used & (F.col("delta") > 0)).alias("windows_delta_gt_0"),
        F.count_if(~used).alias("windows_skipped"),
        F.sum("model_trade_count").alias("pooled_trades"),
        F.sum("_model_gain").alias("_gain"),
        F.sum("_model_loss").alias("_loss"),
    )
    return pooled.join(cuts, list(keys), "left").select(
        *keys,
        "total_windows",
        "windows_used",
        "windows_pf_gt_1",
        "windows_delta_gt_0",
        "windows_skipped",
        "pooled_trades",
        profit_factor(F.col("_gain"), F.col("_loss"), F.col("pooled_trades")).alias("oos_pf_point"),
        "p5",
        "p50",
        "p95",
        passes_gate(F.col("pooled_trades"), F.col("p5")).alias("passes_gate"),
    )
