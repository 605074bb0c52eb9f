"""Data-health diagnostics: feature health, label balance, correlations, regimes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.layout import block_window, drop_halo, with_halo
from barloom.operators.metrics import LOSS_FLOOR
from barloom.operators.quantiles import exact_quantiles


def feature_health(df: DataFrame, features: Sequence[str], by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Percent missing and percent exactly zero per feature; NULL for an absent column.

    One pass: all features are summed in a single aggregation, then unpivoted.
    """
    by = list(by)
    present = [c for c in features if c in df.columns]
    sums = []
    for c in present:
        sums += [F.count_if(F.col(c).isNull()).alias(f"{c}__missing"), F.count_if(F.col(c) == 0).alias(f"{c}__zero")]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *sums)
    percent = lambda c: F.lit(100.0) * F.col(c) / F.col("_n")
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            (percent(f"{c}__missing") if c in present else F.lit(None).cast("double")).alias("pct_missing"),
            (percent(f"{c}__zero") if c in present else F.lit(None).cast("double")).alias("pct_zero"),
        )
        for c in features
    ]
    return wide.select(*by, F.explode(F.array(*rows)).alias("_r")).select(*by, "_r.*")


def staircase_check(df: DataFrame, column: str, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Does a daily value stay constant within each day? Plus duplicate and missing keys.

    Counts per (key, instant) first, so duplicates and distinct values need no
    set of all instants in one place. With a column ``rn``, the order in which rows came, ``monotonic`` tells whether
    time never goes back: the rows of a day lie after those of all earlier days, and in order within it.
    """
    by = list(by)
    if "rn" in df.columns:
        return _staircase(df, column, by).join(_monotonic(df, by), by)
    return _staircase(df, column, by)


def _monotonic(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per key: whether ``ts`` never falls as ``rn`` grows; only days are ordered per key."""
    day = F.to_date("ts")
    inside = Window.partitionBy(*by, "_day").orderBy("rn")
    falls = df.withColumn("_day", day).withColumn("_falls", F.col("ts") < F.lag("ts").over(inside))
    days = falls.groupBy(*by, "_day").agg(F.max("_falls").alias("_falls"), F.min("rn").alias("_a"), F.max("rn").alias("_b"))
    before = F.lag("_b").over(Window.partitionBy(*by).orderBy("_day"))
    out = days.withColumn("_back", F.coalesce(F.col("_falls"), F.lit(False)) | F.coalesce(F.col("_a") < before, F.lit(False)))
    return out.groupBy(*by).agg((~F.max("_back")).alias("monotonic"))


def _staircase(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    days = (
        df.groupBy(*by, "ts")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count_if(F.col(column).isNull()).alias("_missing"),
            F.min(column).alias("_lo"),
            F.max(column).alias("_hi"),
        )
        .groupBy(*by, F.to_date("ts").alias("_day"))
        .agg(
            F.sum("_n").alias("_n"),
            F.sum(F.col("_n") - 1).alias("_dup"),
            F.sum("_missing").alias("_missing"),
            (F.min("_lo") < F.max("_hi")).alias("_steps"),
        )
    )
    return days.groupBy(*by).agg(
        F.sum("_n").alias("n_rows"),
        F.sum("_dup").alias("duplicate_ts"),
        F.sum("_missing").alias("missing"),
        F.count_if("_steps").alias("days_with_steps"),
    )


def class_balance(df: DataFrame, label: str = "target", by: str = "symbol") -> DataFrame:
    """Rows and percent per label, per series and in total (``ALL``)."""
    counts = df.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    both = counts.select(F.explode(F.array(F.col(by), F.lit("ALL"))).alias(by), label, "n")
    totals = both.groupBy(by, label).agg(F.sum("n").alias("n"))
    share = totals.groupBy(by).agg(F.sum("n").alias("_all"))
    return totals.join(share, by).select(by, label, "n", (F.lit(100.0) * F.col("n") / F.col("_all")).alias("pct"))


def neutral_screen(labels: DataFrame, by: Sequence[str], limit: float = 0.5) -> DataFrame:
    """Settings whose share of neutral labels exceeds ``limit``."""
    share = labels.groupBy(*list(by)).agg(F.avg((F.col("target") == 0).cast("int")).alias("neutral_share"))
    return share.filter(F.col("neutral_share") > limit)


def feature_target_corr(
    train: DataFrame,
    features: Sequence[str],
    label: str = "target",
    by: Sequence[str] = ("symbol",),
    k: int = 5,
    undefined: float | None = None,
) -> DataFrame:
    """Strongest and weakest ``k`` features per key by absolute correlation with the label.

    A feature needs ten pairs and more than one value. All correlations come from one
    aggregation; the ranking runs on one short array per key. ``undefined`` stands for a correlation
    whose pairs have one value only on a side: NULL leaves the feature out, NaN ranks as strongest.
    """
    by = list(by)
    aggs = []
    for c in features:
        varied = (F.min(c) < F.max(c)) & (F.min(label) < F.max(label))
        # Not F.corr: in ANSI mode it fails on pairs without variance, whatever condition stands around it.
        spread = F.sqrt(F.regr_sxx(label, c)) * F.sqrt(F.regr_syy(label, c))
        corr = F.when(spread == 0, F.lit(undefined).cast("double")).otherwise(F.try_divide(F.regr_sxy(label, c), spread))
        aggs.append(F.when((F.count(c) >= 10) & varied, corr).alias(c))
    wide = train.groupBy(*by).agg(*aggs)
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in features])
    known = F.filter(entries, lambda e: e["corr"].isNotNull())
    # Ranked by |corr| descending, equal ones by name; NaN is the greatest.
    strength = lambda corr: F.when(F.isnan(corr), F.lit(float("-inf"))).otherwise(-F.round(F.abs(corr), 9))
    ranked = F.array_sort(
        F.transform(known, lambda e: F.struct(strength(e["corr"]).alias("_key"), e["feature"].alias("feature"), e["corr"].alias("corr")))
    )
    rows = wide.select(*by, ranked.alias("_all")).select(*by, F.size("_all").alias("_n"), F.posexplode("_all").alias("_i", "_e"))
    top, bottom = F.col("_i") < k, F.col("_i") >= F.col("_n") - k
    return rows.filter(top | bottom).select(*by, "_e.feature", "_e.corr", top.alias("is_top"), bottom.alias("is_bottom"))


def atr_quantiles(bars: DataFrame, tp: float, cost: float, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Quartiles of ATR in percent of price, and cost in percent of the take-profit distance."""
    share = F.try_divide("atr_14", F.when(F.col("close") != 0, F.col("close")))
    percent = bars.withColumn("_share", F.lit(100.0) * share)
    cuts = exact_quantiles(percent, list(by), "_share", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return cuts.withColumn("cost_pct_of_tp", F.lit(10_000.0) * F.try_divide(F.lit(cost), F.col("median") * tp))


def regime_stats(df: DataFrame, keys: Sequence[str], pos: str = "rn") -> DataFrame:
    """Bars, cumulative return and return deviation of each segment (``split``, regime, ...).

    A segment is a run of neighbouring bars; the first bar of a segment has no return.
    """
    keys = list(keys)
    series = [k for k in keys if k in ("symbol", "timeframe")]
    segment = [k for k in keys if k not in series]
    w = block_window(series, pos)
    out = with_halo(df, back=1, pos=pos)
    previous = F.lag(F.struct("close", *segment)).over(w)
    same = F.lit(True)
    for s in segment:
        same = same & previous[s].eqNullSafe(F.col(s))
    ret = F.when(same, F.try_divide(F.col("close"), F.when(previous["close"] != 0, previous["close"])) - 1)
    out = drop_halo(out.withColumn("_ret", ret))
    for s in segment:
        out = out.filter(F.col(s).isNotNull())
    growth = F.try_divide(F.max_by("close", pos), F.min_by("close", pos)) - 1
    return out.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bars"),
        (F.lit(100.0) * growth).alias("cum_return_pct"),
        (F.lit(100.0) * F.stddev_samp("_ret")).alias("ret_std_pct"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def signal_vs_trend(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of signals fired above the EMA, against the share of all bars above it."""
    above = (F.col("close") > F.col("ema_50")).cast("int")
    return scored.groupBy(*list(keys)).agg(
        F.count_if("signal").alias("n_signals"),
        (F.lit(100.0) * F.avg(F.when(F.col("signal"), F.coalesce(above, F.lit(0))))).alias("signal_above_pct"),
        (F.lit(100.0) * F.avg(F.coalesce(above, F.lit(0)))).alias("base_above_pct"),
    )


def failed_config_stats(configs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range of profit factors among the configurations that failed."""
    return configs.groupBy(*list(keys)).agg(
        F.count(F.lit(1)).alias("n_failed"),
        F.min("profit_factor").alias("min_pf"),
        F.avg("profit_factor").alias("mean_pf"),
        F.max("profit_factor").alias("max_pf"),
    )


def precision(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signals, hits and precision (0 without signals)."""
    hit = F.col("signal") & (F.col("target") == 1)
    sums = scored.groupBy(*list(keys)).agg(F.count_if("signal").alias("signals"), F.count_if(hit).alias("hits"))
    return sums.withColumn("precision", F.coalesce(F.try_divide(F.col("hits"), F.col("signals")), F.lit(0.0)))


def imbalance(df: DataFrame, keys: Sequence[str], label: str = "target") -> DataFrame:
    """Negatives per positive, and balanced class weights ``n / (k * n_c)`` per label."""
    keys = list(keys)
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(
        F.sum("n").alias("_all"),
        F.count(F.lit(1)).alias("_k"),
        F.coalesce(F.sum(F.when(F.col(label) == 1, F.col("n"))), F.lit(0)).alias("_pos"),
    )
    return counts.join(totals, keys).select(
        *keys,
        label,
        "n",
        (F.col("_all") / (F.col("_k") * F.col("n"))).alias("class_weight"),
        ((F.col("_all") - F.col("_pos")) / F.greatest("_pos", F.lit(1))).alias("neg_per_pos"),
    )


#: A live profit factor below this for two weeks pauses the bot.
PAUSE_BELOW = 0.85
WEEK_SECONDS = 7 * 86_400


def live_verdict(trades: DataFrame, bands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Live profit factor from realised trades against the band of the backtest.

    ``trades`` has ``ts`` and ``realized_pnl``; ``bands`` has ``pf_p5`` and ``pf_p95`` per key. Weeks count back from
    the key's newest trade: two weeks in a row below 0.85 pause, the newest week below ``0.9 * p5`` is
    to be monitored; a week without trades is below nothing.
    """
    keys = list(keys)
    pnl = F.col("realized_pnl")
    newest = trades.groupBy(*keys).agg(F.max("ts").alias("_newest"))
    age = F.unix_seconds(F.col("_newest").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    aged = trades.join(newest, keys).withColumn("_week", F.floor(age / WEEK_SECONDS))

    def factor(rows: Column) -> Column:
        gain = F.coalesce(F.sum(F.when(rows & (pnl > 0), pnl)), F.lit(0.0))
        loss = F.coalesce(F.sum(F.when(rows & (pnl < 0), -pnl)), F.lit(0.0))
        return F.when(F.count_if(rows) > 0, gain / F.greatest(loss, F.lit(LOSS_FLOOR)))

    live = aged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        factor(F.lit(True)).alias("live_pf"),
        factor(F.col("_week") == 0).alias("_week0"),
        factor(F.col("_week") == 1).alias("_week1"),
    )
    verdict = (
        F.when((F.col("_week0") < PAUSE_BELOW) & (F.col("_week1") < PAUSE_BELOW), "pause")
        .when(F.col("_week0") < F.col("pf_p5") * 0.9, "monitor")
        .when(F.col("live_pf") > F.col("pf_p95") * 1.2, "favorable")
        .otherwise("within_expectation")
    )
    return live.join(bands, keys).select(*keys, "trades", "live_pf", verdict.alias("verdict"))
