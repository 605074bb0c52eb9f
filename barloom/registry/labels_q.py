"""Queries on labels, class balance, data health and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.keys import r6
from barloom.operators.indicators import technicals
from barloom.operators.labels import Barrier, barrier_labels, barrier_labels_ltf, extrema_labels, label_grid
from barloom.operators.splits import temporal_split
from barloom.plans import diagnostics as diag
from barloom.plans import enrich
from barloom.registry import fixtures as fx
from barloom.registry import oracle_parts as op
from barloom.registry.core import query
from barloom.registry.features_q import rounded, rounded_sql
from barloom.registry.oracle_parts import dbl, with_sql

GRID = [Barrier(s, tp, sl) for s in (5, 7, 10) for tp in (1.0, 1.5, 2.0) for sl in (1.0, 1.5) if tp >= sl]
GRID_SQL = ", ".join(f"({b.swing}, {dbl(b.tp)}, {dbl(b.sl)})" for b in GRID)


def atr_bars(spark, sf, tf):
    return technicals(fx.bars(spark, sf, tf), ["atr_14"])


@query("barrier_labels", with_sql({**op.atr("4h"), **op.labels("a")},
    f"SELECT symbol, ts, target, {op.r6('target_ret')} AS target_ret, label_complete FROM lab WHERE atr_14 IS NOT NULL", recursive=True))
def barrier_labels_q(spark, sf):
    out = barrier_labels(atr_bars(spark, sf, "4h")).filter("atr_14 IS NOT NULL")
    return rounded(out, ("target_ret",), "symbol", "ts", "target", "label_complete")


def _ltf_sql():
    s, t = "(a.close - a.atr_14)", f"(a.close + a.atr_14 * {dbl(1.5)})"
    return with_sql(
        {**op.atr("4h"), "bars_1h": None,
         "hit": f"""SELECT a.symbol, a.rn, arg_min(CASE WHEN l.low <= {s} THEN -1 ELSE 1 END, l.ts) AS first_hit
          FROM a JOIN bars_1h l ON l.symbol = a.symbol AND l.ts >= a.ts + INTERVAL 4 HOURS AND l.ts <= a.ts + INTERVAL 40 HOURS
          WHERE l.low <= {s} OR l.high >= {t} GROUP BY 1, 2""",
         "x": """SELECT a.*, coalesce(h.first_hit, 0) AS target,
          coalesce(lead(a.close, 10) OVER (PARTITION BY a.symbol ORDER BY a.rn), a.last_close) AS exit_close
          FROM a LEFT JOIN hit h ON h.symbol = a.symbol AND h.rn = a.rn"""},
        f"SELECT symbol, ts, target, {op.r6(op.ternary())} AS target_ret FROM x WHERE atr_14 IS NOT NULL",
        recursive=True,
    )


@query("barrier_labels_ltf", _ltf_sql())
def barrier_labels_ltf_q(spark, sf):
    out = barrier_labels_ltf(atr_bars(spark, sf, "4h"), fx.bars(spark, sf, "1h"), "4h").filter("atr_14 IS NOT NULL")
    return rounded(out, ("target_ret",), "symbol", "ts", "target")


@query("barrier_labels_extrema", with_sql(
    {**op.atr("4h"),
     "x": """SELECT *, count(high) OVER w AS n, max(high) OVER w AS hi, min(low) OVER w AS lo FROM a
      WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)"""},
    f"""SELECT symbol, ts, CASE WHEN n = 10 AND hi >= close + atr_14 * {dbl(1.5)} AND lo > close - atr_14 THEN 1 ELSE 0 END
    AS target_extrema FROM x""", recursive=True))
def barrier_labels_extrema(spark, sf):
    return extrema_labels(atr_bars(spark, sf, "4h")).select("symbol", "ts", "target_extrema")


def _grid_ctes():
    return {
        **op.atr("4h"),
        "configs": f"SELECT * FROM (VALUES {GRID_SQL}) t(swing, tp, sl)",
        "off": """SELECT x.symbol, x.rn, c.swing, c.tp, c.sl,
          min(f.rn - x.rn) FILTER (f.low <= x.close - x.atr_14 * c.sl) AS sl_off,
          min(f.rn - x.rn) FILTER (f.high >= x.close + x.atr_14 * c.tp) AS tp_off
          FROM a x CROSS JOIN configs c
          LEFT JOIN a f ON f.symbol = x.symbol AND f.rn BETWEEN x.rn + 1 AND x.rn + c.swing GROUP BY ALL""",
        "g": """SELECT o.*, CASE WHEN sl_off <= coalesce(tp_off, 1000000) THEN -1 WHEN tp_off IS NOT NULL THEN 1 ELSE 0 END AS target
          FROM off o JOIN a ON a.symbol = o.symbol AND a.rn = o.rn WHERE a.atr_14 IS NOT NULL""",
    }


@query("label_grid", with_sql(_grid_ctes(),
    """SELECT symbol, swing, tp, sl, count(*) FILTER (target = 1) AS n_tp, count(*) FILTER (target = 0) AS n_timeout,
    count(*) FILTER (target = -1) AS n_sl, sum(rn * target)::BIGINT AS checksum FROM g GROUP BY ALL""", recursive=True))
def label_grid_q(spark, sf):
    bars = atr_bars(spark, sf, "4h")
    out = label_grid(bars, GRID, payload=["symbol", "timeframe", "ts", "atr_14"]).filter("atr_14 IS NOT NULL")
    return out.groupBy("symbol", "swing", "tp", "sl").agg(
        F.count_if(F.col("target") == 1).alias("n_tp"),
        F.count_if(F.col("target") == 0).alias("n_timeout"),
        F.count_if(F.col("target") == -1).alias("n_sl"),
        F.sum(F.col("rn") * F.col("target")).alias("checksum"),
    )


@query("neutral_screen", with_sql(_grid_ctes(),
    f"""SELECT symbol, swing, tp, sl, {op.r6('avg((target = 0)::INT)')} AS neutral_share FROM g GROUP BY ALL
    HAVING avg((target = 0)::INT) > 0.5""", recursive=True))
def neutral_screen(spark, sf):
    bars = atr_bars(spark, sf, "4h")
    labels = label_grid(bars, GRID, payload=["symbol", "timeframe", "ts", "atr_14"]).filter("atr_14 IS NOT NULL")
    return rounded(diag.neutral_screen(labels, ["symbol", "swing", "tp", "sl"]), ("neutral_share",), "symbol", "swing", "tp", "sl")


def _labelled_sql():
    return {**op.atr("4h"), **op.labels("a")}


@query("class_balance", with_sql(_labelled_sql(),
    f"""SELECT coalesce(symbol, 'ALL') AS symbol, target, count(*) AS n,
    {op.r6('100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY symbol)')} AS pct
    FROM lab GROUP BY GROUPING SETS ((symbol, target), (target))""", recursive=True))
def class_balance(spark, sf):
    out = diag.class_balance(barrier_labels(atr_bars(spark, sf, "4h")))
    return rounded(out, ("pct",), "symbol", "target", "n")


HEALTH = ("rsi_14", "macd", "macd_hist", "stoch_k", "ema_50", "dist_ema_50", "adx_14", "atr_14", "bb_width", "bb_pos",
          "obv", "vol_sma_20", "rel_volume", "fng_value", "fng_sma_14", "fng_vol_14")


def full_dataset(spark, sf, tf="4h"):
    return enrich.add_sentiment(technicals(fx.bars(spark, sf, tf)), fx.fng_daily(spark, sf))


def _health_sql():
    parts = " UNION ALL ".join(
        f"""SELECT symbol, '{c}' AS feature, {op.r6(f'100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*)')} AS pct_missing,
        {op.r6(f'100.0::DOUBLE * count(*) FILTER ({c} = 0) / count(*)')} AS pct_zero FROM fs GROUP BY symbol""" for c in HEALTH)
    missing = "SELECT DISTINCT symbol, 'not_a_column', NULL::DOUBLE, NULL::DOUBLE FROM fs"
    return with_sql({**op.features("4h"), **op.with_sentiment()}, f"{parts} UNION ALL {missing}", recursive=True)


@query("feature_health", _health_sql())
def feature_health(spark, sf):
    out = diag.feature_health(full_dataset(spark, sf), [*HEALTH, "not_a_column"])
    return rounded(out, ("pct_missing", "pct_zero"), "symbol", "feature")


@query("staircase_check", with_sql({"bars_4h": None, **op.with_sentiment("bars_4h")},
    """SELECT symbol, count(*) AS n_rows, count(*) - count(DISTINCT ts) AS duplicate_ts,
    count(*) FILTER (fng_value IS NULL) AS missing,
    (SELECT count(*) FROM (SELECT symbol, date_trunc('day', ts) AS day FROM fs GROUP BY ALL HAVING count(DISTINCT fng_value) > 1) q
     WHERE q.symbol = fs.symbol) AS days_with_steps FROM fs GROUP BY symbol"""))
def staircase_check(spark, sf):
    return diag.staircase_check(enrich.add_sentiment(fx.bars(spark, sf, "4h"), fx.fng_daily(spark, sf)), "fng_value")


def _corr_sql():
    parts = " UNION ALL ".join(
        f"""SELECT symbol, '{c}' AS feature, CASE WHEN count({c}) >= 10 AND count(DISTINCT {c}) > 1 AND count(DISTINCT target) > 1
        THEN corr({c}, target) END AS corr FROM train GROUP BY symbol""" for c in HEALTH)
    return with_sql(
        {**op.features("1h"), **op.with_sentiment(), **op.labels("fs"),
         "sz": """SELECT DISTINCT symbol, n_bars, n_bars - 20 AS alloc, greatest(80, floor((n_bars - 20) * 0.15::DOUBLE)::BIGINT) AS nv,
           greatest(100, floor((n_bars - 20) * 0.15::DOUBLE)::BIGINT) AS nt FROM b""",
         "train": """SELECT l.* FROM lab l JOIN sz USING (symbol) WHERE sz.n_bars >= 400 AND nv + nt <= alloc * 0.45::DOUBLE
           AND alloc - nv - nt >= 200 AND l.rn < alloc - nv - nt""",
         "c": parts,
         "k": """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(abs(corr), 9) DESC, feature) AS top_rank,
          row_number() OVER (PARTITION BY symbol ORDER BY round(abs(corr), 9), feature DESC) AS bottom_rank FROM c WHERE corr IS NOT NULL"""},
        f"""SELECT symbol, feature, {op.r6('corr')} AS corr, top_rank <= 5 AS is_top, bottom_rank <= 5 AS is_bottom
        FROM k WHERE top_rank <= 5 OR bottom_rank <= 5""", recursive=True)


@query("feature_target_corr", _corr_sql())
def feature_target_corr(spark, sf):
    labelled = barrier_labels(full_dataset(spark, sf, "1h"))
    train = temporal_split(labelled, swing=5, embargo=10).filter("split = 'train'")
    # As its SQL has it, a correlation without variance is NaN.
    out = diag.feature_target_corr(train, HEALTH, k=5, undefined=float("nan"))
    return rounded(out, ("corr",), "symbol", "feature", "is_top", "is_bottom")


@query("atr_quantiles", with_sql(op.atr("1h"),
    f"""SELECT symbol, {op.r6('100 * quantile_cont(atr_14 / close, 0.25)')} AS p25, {op.r6('100 * quantile_cont(atr_14 / close, 0.5)')} AS median,
    {op.r6('100 * quantile_cont(atr_14 / close, 0.75)')} AS p75,
    {op.r6('100 * 0.003::DOUBLE / (quantile_cont(atr_14 / close, 0.5) * 1.5::DOUBLE)')} AS cost_pct_of_tp
    FROM a WHERE atr_14 IS NOT NULL GROUP BY symbol""", recursive=True))
def atr_quantiles(spark, sf):
    out = diag.atr_quantiles(atr_bars(spark, sf, "1h"), tp=1.5, cost=0.003)
    return rounded(out, ("p25", "median", "p75", "cost_pct_of_tp"), "symbol")


_SPLIT_CTES = {
    "n": "SELECT symbol, any_value(n_bars) AS n_bars FROM b GROUP BY symbol",
    "z": """SELECT symbol, n_bars - 20 AS alloc, greatest(8 * 50, floor((n_bars - 20) * 0.15::DOUBLE)::BIGINT) AS nv,
      greatest(10 * 50, floor((n_bars - 20) * 0.15::DOUBLE)::BIGINT) AS nt, n_bars FROM n""",
    "ok": """SELECT *, alloc - nv - nt AS ntr FROM z WHERE n_bars >= 200 + 400 + 500 + 20
      AND nv + nt <= alloc * 0.45::DOUBLE AND alloc - nv - nt >= 200""",
    "s": """SELECT b.*, CASE WHEN rn < ntr THEN 'train' WHEN rn >= ntr + 10 AND rn < ntr + 10 + nv THEN 'val'
      WHEN rn >= ntr + 20 + nv AND rn < ntr + 20 + nv + nt THEN 'test' END AS split
      FROM b LEFT JOIN ok ON ok.symbol = b.symbol""",
}


@query("temporal_split", with_sql({**op.numbered("1d"), **_SPLIT_CTES},
    """SELECT symbol, coalesce(split, 'gap') AS split, count(*) AS n, min(rn) AS first_rn, max(rn) AS last_rn FROM s GROUP BY ALL"""))
def temporal_split_q(spark, sf):
    out = temporal_split(fx.bars(spark, sf, "1d"), swing=10, embargo=10)
    return out.groupBy("symbol", F.coalesce("split", F.lit("gap")).alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn")
    )


@query("regime_stats", with_sql({**op.numbered("1d"), **_SPLIT_CTES,
    "q": "SELECT *, close / lag(close) OVER (PARTITION BY symbol, split ORDER BY rn) - 1 AS ret FROM s WHERE split IS NOT NULL"},
    f"""SELECT symbol, split, count(*) AS n_bars, {op.r6('100 * (arg_max(close, rn) / arg_min(close, rn) - 1)')} AS cum_return_pct,
    {op.r6('100 * stddev_samp(ret)')} AS ret_std_pct, min(ts) AS first_ts, max(ts) AS last_ts FROM q GROUP BY ALL"""))
def regime_stats(spark, sf):
    out = diag.regime_stats(temporal_split(fx.bars(spark, sf, "1d"), swing=10, embargo=10), ["symbol", "timeframe", "split"])
    return rounded(out, ("cum_return_pct", "ret_std_pct"), "symbol", "split", "n_bars", "first_ts", "last_ts")
