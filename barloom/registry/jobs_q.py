"""Queries on the composed research jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.keys import r6
from barloom.operators.indicators import technicals
from barloom.operators.labels import Barrier, barrier_labels, extrema_labels
from barloom.operators.columns import DATASET_DROP, clean, infer_features, strategies
from barloom.operators.layout import with_position
from barloom.plans import diagnostics, jobs, models, sweep
from barloom.plans import walkforward as wf
from barloom.plans.config import FORMULATIONS, ExperimentConfig
from barloom.plans.dataset import Sources, build_dataset
from barloom.registry import fixtures as fx
from barloom.registry import oracle_parts as op
from barloom.registry.core import query
from barloom.registry.features_q import rounded, rounded_sql
from barloom.registry.labels_q import atr_bars
from barloom.registry.oracle_parts import dbl, with_sql
from barloom.registry.trades_q import BASE_CTES, CONFIG, COST, KEYS, RUN_COUNTS, SWING, WF_CTES, run_ctes, wf_bars
from barloom.operators.trades import BINARY_GRID, MULTICLASS_GRID, REGRESSION_GRID, threshold_grid
from barloom.session import cut_lineage

GRIDS = {"binary_homerun": threshold_grid(*BINARY_GRID), "multiclass_3": threshold_grid(*MULTICLASS_GRID), "regression_return": threshold_grid(*REGRESSION_GRID)}
VARIANTS = ("CONTROL", "TREATMENT")
RUN_DOUBLES = ("oos_pf_point", "p5", "p95")


def variant_scorer(variants, formulations):
    """Hash scores for every combination, as extra run keys on the rows."""
    options = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(f).alias("formulation")) for v in variants for f in formulations])

    def scorer(slices):
        wide = slices.withColumn("_o", F.explode(options)).select(*slices.columns, "_o.*")
        parts = [F.col(c) for c in ("symbol", "timeframe", "rn", "variant", "formulation")]
        return wide.withColumn("score", fx.md5_score(*parts))

    return scorer


def matrix(spark, sf, variants):
    ready, bounds = wf.prepare(wf_bars(spark, sf), CONFIG)
    return wf.evaluate(
        ready, bounds, variant_scorer(variants, GRIDS), CONFIG, GRIDS, ("variant", "formulation")
    ).runs


def matrix_ctes(variants):
    values = ", ".join(f"('{v}', '{f}')" for v in variants for f in GRIDS)
    base = dict(BASE_CTES)
    base["sl0"] = base.pop("sl")
    sr = base.pop("sr")
    base["sl"] = f"""SELECT * REPLACE ({op.md5_score('symbol', "'1d'", 'rn', 'variant', 'formulation')} AS score)
      FROM (SELECT s.*, g.lo + pos AS rn FROM sl0 s JOIN rg g USING (symbol, fold, part)), (VALUES {values}) v(variant, formulation)"""
    base["sr"] = sr
    return {**base, **run_ctes(("variant", "formulation"), GRIDS)}


@query("baseline_screen", with_sql(matrix_ctes(VARIANTS[:1]),
    f"SELECT {rounded_sql(RUN_DOUBLES, 'symbol', 'formulation', *RUN_COUNTS, 'passes_gate')} FROM run", recursive=True))
def baseline_screen(spark, sf):
    return rounded(matrix(spark, sf, VARIANTS[:1]), RUN_DOUBLES, "symbol", "formulation", *RUN_COUNTS, "passes_gate")


_AB = {**matrix_ctes(VARIANTS),
    "cp": """SELECT t.symbol, t.formulation, t.p5 - c.p5 AS delta_p5, t.p95 - c.p95 AS delta_p95, t.pooled_trades - c.pooled_trades AS delta_trades,
      CASE WHEN NOT c.passes_gate AND t.passes_gate THEN 'to_pass' WHEN c.passes_gate AND NOT t.passes_gate THEN 'to_fail' ELSE 'none' END AS gate_flip
      FROM run c JOIN run t USING (symbol, formulation) WHERE c.variant = 'CONTROL' AND t.variant = 'TREATMENT'"""}


@query("ab_compare", with_sql(_AB, f"SELECT {rounded_sql(('delta_p5', 'delta_p95'), 'symbol', 'formulation', 'delta_trades', 'gate_flip')} FROM cp", recursive=True))
def ab_compare(spark, sf):
    out = sweep.ab_compare(matrix(spark, sf, VARIANTS), [*KEYS, "formulation"])
    return rounded(out, ("delta_p5", "delta_p95"), "symbol", "formulation", "delta_trades", "gate_flip")


# --- a real treatment: the daily trend decides half of the treated score --------------------


def orders_sentiment(spark, sf):
    """A daily index over the days of the orders: the share of finished ones."""
    orders = fx.table(spark, sf, "orders")
    done = F.count_if(F.col("o_orderstatus") == "F")
    return orders.groupBy(F.col("o_orderdate").alias("ts")).agg(F.floor(F.lit(100.0) * done / F.count(F.lit(1))).cast("double").alias("fng_value"))


def trend_dataset(spark, sf):
    bars = fx.daily_bars(spark, sf)
    return build_dataset(bars, Sources(sentiment=orders_sentiment(spark, sf), daily_bars=bars), "trend_htf")


TREND_COLUMNS = ("rsi_14", "macd", "macd_hist", "stoch_k", "dist_ema_50", "adx_14", "atr_14", "bb_width", "bb_pos", "obv",
                 "rel_volume", "fng_value", "fng_sma_14", "fng_vol_14", "trend_htf", "close", "target_ret")
TREND_CTES = {
    **op.features("1d"),
    "fng_daily": "SELECT o_orderdate AS ts, floor(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(*)) AS fng_value FROM orders GROUP BY 1",
    "fng": op.SENTIMENT["fng"],
    "fs": op.with_sentiment()["fs"],
    **op.ema("r_trend", "b", "close", 200),
    "td": """SELECT b.symbol, b.ts + INTERVAL 1 DAYS AS at, (b.close - r.y) / r.y AS trend_htf FROM b JOIN r_trend r ON r.symbol = b.symbol AND r.rn = b.rn""",
    "ft": "SELECT x.*, t.trend_htf FROM fs x ASOF LEFT JOIN td t ON x.symbol = t.symbol AND x.ts >= t.at",
    **op.labels("ft"),
    "tz": f"SELECT * REPLACE (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn) FROM lab WHERE {' AND '.join(c + ' IS NOT NULL' for c in TREND_COLUMNS)}",
}


@query("dataset_trend_htf", with_sql(TREND_CTES, f"SELECT {rounded_sql(TREND_COLUMNS, 'symbol', 'ts', 'target', 'rn')} FROM tz", recursive=True))
def dataset_trend_htf(spark, sf):
    out, features = trend_dataset(spark, sf)
    assert len(features) == 14 and "trend_htf" not in features
    return rounded(out, TREND_COLUMNS, "symbol", "ts", "target", "rn")


def treated(slices):
    """The control score is a hash; the treated one is half of it, and half the sign of the trend."""
    base = fx.md5_score(*[F.col(c) for c in ("symbol", "timeframe", "rn")])
    score = F.when(F.col("variant") == "CONTROL", base).otherwise(0.5 * base + F.when(F.col("trend_htf") > 0, 0.5).otherwise(0.0))
    return slices.withColumn("variant", F.explode(F.lit(list(VARIANTS)))).withColumn("score", score)


def trend_ctes():
    base = {k: v for k, v in BASE_CTES.items() if k in ("span", "r_f", "fw", "bd", "bz", "bnd", "rg", "sl", "sr")}
    base["sl0"] = base.pop("sl")
    sr = base.pop("sr")
    base["sl"] = """SELECT s.* REPLACE (CASE variant WHEN 'CONTROL' THEN score ELSE 0.5::DOUBLE * score + CASE WHEN k.trend_htf > 0 THEN 0.5::DOUBLE ELSE 0 END END AS score), variant
      FROM sl0 s JOIN c k USING (symbol, ts), (VALUES ('CONTROL'), ('TREATMENT')) v(variant)"""
    base["sr"] = sr
    return {
        **TREND_CTES, "c": "SELECT * FROM tz", **base, **run_ctes(("variant",)),
        "cp": _AB["cp"].replace("t.symbol, t.formulation,", "t.symbol,").replace("USING (symbol, formulation)", "USING (symbol)"),
    }


@query("ab_trend_htf", with_sql(trend_ctes(),
    f"SELECT {rounded_sql(('delta_p5', 'delta_p95'), 'symbol', 'delta_trades', 'gate_flip')} FROM cp", recursive=True))
def ab_trend_htf(spark, sf):
    dataset, _ = trend_dataset(spark, sf)
    ready, bounds = wf.prepare(dataset, CONFIG)
    runs = wf.evaluate(ready, bounds, treated, CONFIG, GRIDS["binary_homerun"], ("variant",), ("trend_htf",)).runs
    return rounded(sweep.ab_compare(runs, KEYS), ("delta_p5", "delta_p95"), "symbol", "delta_trades", "gate_flip")


@query("ab_models")
def ab_models(spark, sf):
    """The same test with fitted models: all features against all features and the trend."""
    dataset, features = trend_dataset(spark, sf)
    ready, bounds = wf.prepare(dataset, CONFIG)
    scorer = models.model_scorer(ready, bounds, {"CONTROL": features, "TREATMENT": [*features, "trend_htf"]}, ("binary_homerun",))
    grids = {"binary_homerun": GRIDS["binary_homerun"]}
    runs = wf.evaluate(ready, bounds, scorer, CONFIG, grids, models.RUN_KEYS, ("target_ret", *features, "trend_htf")).runs
    return rounded(sweep.ab_compare(runs, [*KEYS, "formulation"]), ("delta_p5", "delta_p95"), "symbol", "formulation", "delta_trades", "gate_flip")


# Verdicts over a run table derived from events: one run per symbol, timeframe slot,
# formulation slot and seed slot, with signed percentiles.
_RUNS_SQL = """SELECT event_type AS symbol, CASE WHEN user_id % 2 = 0 THEN '4h' ELSE '1h' END AS timeframe, 'f' || (user_id % 3) AS formulation,
  min(value) - 0.5 AS p5, max(value) AS p95, min(value) > 0.5 AND count(*) >= 100 AS passes_gate FROM events GROUP BY 1, 2, 3"""


def run_rows(spark, sf):
    events = fx.table(spark, sf, "events")
    return events.groupBy(
        F.col("event_type").alias("symbol"),
        F.when(F.col("user_id") % 2 == 0, "4h").otherwise("1h").alias("timeframe"),
        F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")).alias("formulation"),
    ).agg(
        (F.min("value") - 0.5).alias("p5"), F.max("value").alias("p95"),
        ((F.min("value") > 0.5) & (F.count(F.lit(1)) >= 100)).alias("passes_gate"),
    )


@query("verdict_matrix", f"""WITH r AS ({_RUNS_SQL}),
    s AS (SELECT symbol, count(*) AS n_runs, count(*) FILTER (passes_gate) AS n_pass, count(DISTINCT timeframe) FILTER (passes_gate) AS tf,
      count(DISTINCT formulation) FILTER (passes_gate) AS fm FROM r GROUP BY symbol)
    SELECT symbol, n_runs, n_pass, CASE WHEN n_pass = 0 THEN 'reject' WHEN n_pass <= 2 AND (tf = 1 OR fm = 1) THEN 'conditional' ELSE 'approve' END AS asset_verdict,
    CASE WHEN n_pass = 0 THEN 'failed' WHEN n_pass <= 2 THEN 'suspicious' ELSE 'successful' END AS feature_verdict FROM s""")
def verdict_matrix(spark, sf):
    runs = run_rows(spark, sf)
    asset = sweep.asset_verdict(runs).withColumnRenamed("verdict", "asset_verdict")
    feature = sweep.feature_verdict(runs, ["symbol"]).select("symbol", F.col("verdict").alias("feature_verdict"))
    return asset.join(feature, "symbol")


@query("rigor_check", f"""WITH r AS ({_RUNS_SQL})
    SELECT symbol, timeframe, count(*) AS n_runs, count(*) FILTER (passes_gate) AS n_pass, bool_and(p5 > 0) AS all_positive,
    {op.r6('max(p95 - p5)')} AS max_ci_width, bool_and(p5 > 0) AND bool_or(passes_gate) AND max(p95 - p5) <= 500 AS rigorous FROM r GROUP BY ALL""")
def rigor_check(spark, sf):
    return rounded(sweep.rigor_check(run_rows(spark, sf), max_ci_width=500.0), ("max_ci_width",), "symbol", "timeframe", "n_runs", "n_pass", "all_positive", "rigorous")


@query("failed_configs", f"""WITH r AS ({_RUNS_SQL})
    SELECT symbol, count(*) AS n_failed, {op.r6('min(p95)')} AS min_pf, {op.r6('avg(p95)')} AS mean_pf, {op.r6('max(p95)')} AS max_pf
    FROM r WHERE NOT passes_gate GROUP BY symbol""")
def failed_configs(spark, sf):
    from barloom.plans.diagnostics import failed_config_stats

    failed = run_rows(spark, sf).filter(~F.col("passes_gate")).withColumn("profit_factor", F.col("p95"))
    return rounded(failed_config_stats(failed, ["symbol"]), ("min_pf", "mean_pf", "max_pf"), "symbol", "n_failed")


# --- naive against model on the held-out splits of daily bars ------------------------


def clean_daily(spark, sf):
    """Daily bars with ATR and no missing rows, positions from zero."""
    bars = atr_bars(spark, sf, "1d").filter("atr_14 IS NOT NULL")
    return bars.withColumns({"rn": F.col("rn") - 13, "n_bars": F.col("n_bars") - 13})


def hash_rows(df):
    """Scores from the instant, which no operator changes."""
    return df.withColumn("score", fx.md5_score(F.col("symbol"), F.date_format("ts", "yyyy-MM-dd")))


_HASH_SQL = op.md5_score("symbol", "strftime(ts, '%Y-%m-%d')")


def split_eval_ctes(swing, split_swing, payoff_label="target", prefix="", tp=1.5, sl=1.0, pairs=(), factor=5, score=_HASH_SQL):
    """Held-out slices with naive and model metrics; CTE names carry ``prefix``.

    With ``pairs`` the barrier settings (tp, sl) are key columns. ``factor`` is that of the timeframe.
    """
    p = prefix
    cfg = ["tp", "sl"] if pairs else []
    more = "".join(f", {x}" for x in cfg)
    payoff = op.ternary(tp, sl)
    lab = op.labels("c0", swing, tp, sl, name=f"{p}lab")
    if pairs:
        values = ", ".join(f"({dbl(a)}, {dbl(b)})" for a, b in pairs)
        payoff = "(CASE target WHEN 1 THEN atr_14 * tp / close WHEN -1 THEN -(atr_14 * sl / close) ELSE (exit_close - close) / close END)"
        lab = {
            f"{p}x": f"SELECT c0.*, tp, sl FROM c0, (VALUES {values}) v(tp, sl)",
            f"{p}off": f"""SELECT x.symbol, x.rn, x.tp, x.sl, min(f.rn - x.rn) FILTER (f.low <= x.close - x.atr_14 * x.sl) AS sl_off,
              min(f.rn - x.rn) FILTER (f.high >= x.close + x.atr_14 * x.tp) AS tp_off
              FROM {p}x x LEFT JOIN c0 f ON f.symbol = x.symbol AND f.rn BETWEEN x.rn + 1 AND x.rn + {swing} GROUP BY ALL""",
            f"{p}lab": f"""SELECT x.*, CASE WHEN sl_off <= coalesce(tp_off, 1000000) THEN -1 WHEN tp_off IS NOT NULL THEN 1 ELSE 0 END AS target,
              NULL::DOUBLE AS exit_close FROM {p}x x JOIN {p}off USING (symbol, rn, tp, sl)""",
        }
    per, gap = split_swing * factor, swing
    from barloom.registry.trades_q import PRODUCTION_GRID, _search_ctes

    grid = ", ".join(f"({dbl(t)})" for t in PRODUCTION_GRID)
    search = {}
    for key, body in _search_ctes(f"{p}v", ["symbol", *cfg], PRODUCTION_GRID, f"greatest(10, floor(greatest(1.0::DOUBLE, n_rows / {dbl(float(swing))}) * 0.15::DOUBLE))", "ret", swing).items():
        search[key] = body
    renames = {k: (f"r_{p}{k[2:]}" if k.startswith("r_") else f"nx_r_{p}{k[5:]}" if k.startswith("nx_r_") else f"{p}{k}") for k in search}

    def fix(body):
        import re

        for old, new in sorted(renames.items(), key=lambda kv: -len(kv[0])):
            body = re.sub(rf"\b{old}\b(?!\()", new, body)
        return body

    search = {renames[k]: fix(b) for k, b in search.items()}
    equity = lambda src: f"""SELECT *, product(1 + ret) OVER (PARTITION BY symbol, split{more} ORDER BY pos) AS eq FROM {src}"""
    drawdown = lambda src: f"""SELECT symbol, split{more}, greatest(0, max((pk - eq) / pk)) AS dd FROM
      (SELECT *, greatest(1, max(eq) OVER (PARTITION BY symbol, split{more} ORDER BY pos)) AS pk FROM {src}) GROUP BY ALL"""
    metric = lambda src: f"""SELECT symbol, split{more}, count(*) AS n, sum(CASE target WHEN 1 THEN ret WHEN -1 THEN 0 ELSE greatest(ret, 0) END)
      / greatest(sum(CASE target WHEN -1 THEN abs(ret) WHEN 1 THEN 0 ELSE greatest(-ret, 0) END), 1e-9::DOUBLE) AS pf FROM {src} GROUP BY ALL"""
    return {
        f"{p}n": "SELECT symbol, count(*) AS n_bars FROM c0 GROUP BY symbol",
        f"{p}z": f"""SELECT *, greatest(8 * {per}, floor((n_bars - {2 * gap}) * 0.15::DOUBLE)::BIGINT) AS nv,
          greatest(10 * {per}, floor((n_bars - {2 * gap}) * 0.15::DOUBLE)::BIGINT) AS nt, n_bars - {2 * gap} AS alloc FROM {p}n""",
        f"{p}ok": f"""SELECT *, alloc - nv - nt AS ntr FROM {p}z WHERE n_bars >= 200 + 18 * {per} + {2 * gap}
          AND nv + nt <= alloc * 0.45::DOUBLE AND alloc - nv - nt >= 200""",
        **lab,
        f"{p}s": f"""SELECT l.*, CASE WHEN rn >= ntr + {gap} AND rn < ntr + {gap} + nv THEN 'val' WHEN rn >= ntr + {2 * gap} + nv AND rn < ntr + {2 * gap} + nv + nt THEN 'test' END AS split
          FROM {p}lab l JOIN {p}ok USING (symbol)""",
        f"{p}h": f"""SELECT * EXCLUDE (exit_close), row_number() OVER w - 1 AS pos, {score} AS score,
          coalesce(lead(close, {swing}) OVER w, last(close) OVER (PARTITION BY symbol, split{more} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS exit_close
          FROM {p}s WHERE split IS NOT NULL WINDOW w AS (PARTITION BY symbol, split{more} ORDER BY rn)""",
        f"{p}e": f"SELECT *, {payoff} AS ret FROM {p}h",
        f"{p}v": f"SELECT * FROM {p}e WHERE split = 'val'",
        **search,
        f"{p}mc": f"SELECT e.* FROM {p}e e JOIN {p}best b ON b.symbol = e.symbol {'AND b.tp = e.tp AND b.sl = e.sl' if pairs else ''} AND e.score >= b.threshold",
        **op.picks(f"{p}mc", ["symbol", "split", *cfg], swing, f"r_{p}m"),
        f"{p}mt": f"SELECT c.* FROM {p}mc c JOIN r_{p}m USING (symbol, split, pos{more})",
        f"{p}nt": f"SELECT * FROM {p}e WHERE pos % {swing} = 0",
        f"{p}mm": metric(f"{p}mt"),
        f"{p}mq": equity(f"{p}mt"),
        f"{p}md": drawdown(f"{p}mq"),
        f"{p}nm": metric(f"{p}nt"),
        f"{p}r": f"""SELECT n.symbol, n.split, {swing} AS swing, b.threshold, n.n AS naive_n, n.pf AS naive_pf, m.n::DOUBLE AS model_n, m.pf AS model_pf, m.pf - n.pf AS delta
          FROM {p}nm n LEFT JOIN {p}mm m USING (symbol, split) LEFT JOIN {p}best b ON b.symbol = n.symbol""",
    }


C0 = {
    **op.atr("1d"),
    "c0": "SELECT * REPLACE (rn - 13 AS rn, n_bars - 13 AS n_bars) FROM a WHERE atr_14 IS NOT NULL",
}
_NVM = ("threshold", "naive_pf", "model_pf", "delta")


@query("naive_vs_model", with_sql({**C0, **split_eval_ctes(SWING, SWING)},
    f"SELECT {rounded_sql(_NVM, 'symbol', 'split', 'naive_n', 'model_n')} FROM r", recursive=True))
def naive_vs_model(spark, sf):
    labelled = barrier_labels(clean_daily(spark, sf))
    out = jobs.naive_vs_model(labelled, hash_rows, SWING, 1.5, 1.0)
    out = out.select("symbol", "split", "threshold", F.col("naive_trade_count").alias("naive_n"), F.col("naive_profit_factor").alias("naive_pf"),
                     F.col("model_trade_count").cast("double").alias("model_n"), F.col("model_profit_factor").alias("model_pf"), "delta")
    return rounded(out, _NVM, "symbol", "split", "naive_n", "model_n")


SWINGS = (2, 3, 4, 5, 7, 10)
_SWEEP_ROWS = " UNION ALL ".join(f"SELECT * FROM s{s}r" for s in SWINGS)
_SWEEP = {
    **C0,
    **{k: v for s in SWINGS for k, v in split_eval_ctes(s, max(SWINGS), prefix=f"s{s}").items()},
    "sw": f"""SELECT symbol, swing, max(delta) FILTER (split = 'val') AS delta_val, max(delta) FILTER (split = 'test') AS delta_test,
      max(model_n) FILTER (split = 'val') AS val_n, max(model_n) FILTER (split = 'test') AS test_n FROM ({_SWEEP_ROWS}) GROUP BY ALL""",
    "bs": """SELECT symbol, swing AS best FROM sw WHERE val_n >= 20 AND test_n >= 20
      QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round((delta_val + delta_test) / 2, 12) DESC, swing) = 1""",
}


@query("swing_sweep", with_sql(_SWEEP,
    f"SELECT symbol, swing, {op.r6('delta_val')} AS delta_val, {op.r6('delta_test')} AS delta_test, coalesce(best, 10) AS best_swing FROM sw LEFT JOIN bs USING (symbol)", recursive=True))
def swing_sweep(spark, sf):
    results = cut_lineage(jobs.swing_sweep(clean_daily(spark, sf), hash_rows, SWINGS))
    best = sweep.best_swing(results, ["symbol"])
    return rounded(results.join(best, "symbol"), ("delta_val", "delta_test"), "symbol", "swing", "best_swing")


# --- long swings on hourly bars of the orders, with what the cost takes of the target ------

LONG_SWINGS = (20, 30, 40, 50, 60)
_HOUR_SCORE = op.md5_score("symbol", "strftime(ts, '%Y-%m-%d %H')")


def hourly_orders(spark, sf):
    """One market of hourly bars: three order keys make an hour. With ATR, positions from zero."""
    hour = F.timestamp_micros(F.expr("788918400000000 + (o_orderkey div 3) * 3600000000")).cast("timestamp_ntz")
    orders = fx.table(spark, sf, "orders").withColumns({"o_orderstatus": F.lit("ALL"), "o_orderdate": hour})
    bars = fx.daily_from(orders).withColumn("timeframe", F.lit("1h"))
    return with_position(technicals(bars, ["atr_14"]).filter("atr_14 IS NOT NULL").drop("rn", "n_bars", "last_close"), last="close")


def _long_ctes():
    bars = dict(op.atr("1d"))
    bars["b"] = bars["b"].replace("FROM bars_1d", "FROM bars_h")
    bars.pop("bars_1d")
    hour = "(TIMESTAMP '1995-01-01' + to_hours((o_orderkey // 3)::INT))"
    rows = " UNION ALL ".join(f"SELECT * FROM l{s}r" for s in LONG_SWINGS)
    return {
        "bars_h": fx.SQL["bars_1d"].replace("o_orderstatus AS symbol, '1d' AS timeframe, o_orderdate AS ts", f"'ALL' AS symbol, '1h' AS timeframe, {hour} AS ts"),
        **bars,
        "c0": C0["c0"],
        **{k: v for s in LONG_SWINGS for k, v in split_eval_ctes(s, max(LONG_SWINGS), prefix=f"l{s}", factor=2, score=_HOUR_SCORE).items()},
        "lw": f"""SELECT symbol, swing, max(delta) FILTER (split = 'val') AS delta_val, max(delta) FILTER (split = 'test') AS delta_test,
          max(model_n) FILTER (split = 'val') AS val_trades, max(model_n) FILTER (split = 'test') AS test_trades FROM ({rows}) GROUP BY ALL""",
        "aq": f"""SELECT symbol, quantile_cont(100 * atr_14 / close, 0.25) AS p25, quantile_cont(100 * atr_14 / close, 0.5) AS median,
          quantile_cont(100 * atr_14 / close, 0.75) AS p75, 10000 * {dbl(COST)} / (quantile_cont(100 * atr_14 / close, 0.5) * 1.5) AS cost_pct_of_tp FROM c0 GROUP BY symbol""",
    }


_LONG = ("delta_val", "delta_test", "p25", "median", "p75", "cost_pct_of_tp")


@query("long_swing_sweep", with_sql(_long_ctes(),
    f"SELECT {rounded_sql(_LONG, 'symbol', 'swing', 'val_trades', 'test_trades')} FROM lw JOIN aq USING (symbol)", recursive=True))
def long_swing_sweep(spark, sf):
    bars = cut_lineage(hourly_orders(spark, sf))
    scorer = lambda df: df.withColumn("score", fx.md5_score(F.col("symbol"), F.date_format("ts", "yyyy-MM-dd HH")))
    out = jobs.swing_sweep(bars, scorer, LONG_SWINGS).join(diagnostics.atr_quantiles(bars, 1.5, COST), "symbol")
    return rounded(out.withColumns({f"{s}_trades": F.col(f"{s}_trades").cast("double") for s in ("val", "test")}), _LONG, "symbol", "swing", "val_trades", "test_trades")


@query("label_reconciliation", with_sql(
    {**C0, **split_eval_ctes(SWING, SWING),
     "xt": """SELECT *, count(high) OVER w AS fn, max(high) OVER w AS fh, min(low) OVER w AS fl FROM c0
       WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)""",
     "xo": f"SELECT symbol, rn, (fn = 10 AND fh >= close + atr_14 * {dbl(1.5)} AND fl > close - atr_14)::INT AS t_old FROM xt",
     "xx": """SELECT e.* EXCLUDE (target, ret), regime, CASE WHEN regime = 'new_label_new_payoff' THEN target ELSE t_old END AS target
       FROM e JOIN xo USING (symbol, rn), (VALUES ('old_label_old_payoff'), ('old_label_new_payoff'), ('new_label_new_payoff')) g(regime) WHERE pos % 10 = 0""",
     "xr": f"SELECT *, CASE WHEN regime = 'old_label_old_payoff' THEN {op.binary()} ELSE {op.ternary()} END AS ret FROM xx"},
    f"""SELECT symbol, split, regime, count(*) AS trade_count, {op.r6('''sum(CASE WHEN target = 1 THEN ret WHEN target = -1 OR regime = 'old_label_old_payoff' THEN 0 ELSE greatest(ret, 0) END)
      / greatest(sum(CASE WHEN target = 1 THEN 0 WHEN target = -1 OR regime = 'old_label_old_payoff' THEN abs(ret) ELSE greatest(-ret, 0) END), 1e-9::DOUBLE)''')} AS profit_factor
    FROM xr GROUP BY ALL""", recursive=True))
def label_reconciliation(spark, sf):
    labelled = extrema_labels(barrier_labels(clean_daily(spark, sf)))
    out = jobs.label_reconciliation(labelled, SWING, 1.5, 1.0, SWING)
    return rounded(out, ("profit_factor",), "symbol", "split", "regime", "trade_count")


# --- grid search ---------------------------------------------------------------------

FULL_GRID = [Barrier(s, tp, sl) for s in sweep.PRODUCTION_SWINGS for tp in sweep.PRODUCTION_TP for sl in sweep.PRODUCTION_SL]


def _fitness_sql(pf, dd, n, rows, swing):
    return f"""CASE WHEN {pf} <= 1 THEN -999.0::DOUBLE ELSE (least({pf}, 10) - 1) / greatest({dd}, 0.01::DOUBLE) * ln(greatest({n}, 1))
      * least(1.0::DOUBLE, {n} / greatest(12, floor(greatest(1.0::DOUBLE, {rows} / {swing}::DOUBLE) * 0.15::DOUBLE))) END"""


_PAIRS = list(dict.fromkeys((b.tp, b.sl) for b in FULL_GRID))
_OPT_SWINGS = {f"g{s}": s for s in sweep.PRODUCTION_SWINGS}
_OPT_ROWS = " UNION ALL ".join(
    f"""SELECT m.symbol, m.split, {s} AS swing, m.tp, m.sl, t.threshold, m.n, m.pf, d.dd, z.nv, z.nt
    FROM {p}mm m JOIN {p}md d USING (symbol, split, tp, sl) JOIN {p}best t USING (symbol, tp, sl) JOIN {p}ok z USING (symbol)""" for p, s in _OPT_SWINGS.items())
_OPT = {
    **C0,
    **{k: v for p, s in _OPT_SWINGS.items() for k, v in split_eval_ctes(s, 10, prefix=p, pairs=_PAIRS).items() if k != f"{p}r"},
    "cf": f"""SELECT symbol, split, swing, tp, sl, threshold, n, round(pf, 4) AS pf, round(dd, 4) AS dd, nv,
      round({_fitness_sql('pf', 'dd', 'n', "CASE split WHEN 'val' THEN nv ELSE nt END", "swing")}, 6) AS fitness FROM ({_OPT_ROWS})""",
    "vl": """SELECT *, CASE WHEN n < greatest(8, floor(nv / 50 * 0.5::DOUBLE)) OR pf <= 1.05::DOUBLE THEN -9999.0::DOUBLE + n
      ELSE (pf - 1) / greatest(dd, 0.01::DOUBLE) * ln(n) END AS production FROM cf WHERE split = 'val' AND fitness <> -999""",
    "wn": """SELECT *, count(*) OVER (PARTITION BY symbol) AS n_valid FROM vl
      QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(production, 9) DESC, swing, tp, sl) = 1""",
}


@query("strategy_search", with_sql(_OPT,
    f"""SELECT w.symbol, w.n_valid, w.swing, w.tp, w.sl, {op.r6('w.threshold')} AS threshold, w.n AS trade_count, {op.r6('w.pf')} AS profit_factor, {op.r6('w.dd')} AS max_drawdown,
    {op.r6('w.fitness')} AS fitness, {op.r6('w.production')} AS production, {op.r6('t.fitness')} AS test_fitness,
    coalesce(t.fitness / nullif(greatest(w.fitness, 0), 0) >= 0.5::DOUBLE, false) AS oos_sane
    FROM wn w LEFT JOIN cf t ON t.symbol = w.symbol AND t.swing = w.swing AND t.tp = w.tp AND t.sl = w.sl AND t.split = 'test'""", recursive=True))
def strategy_search(spark, sf):
    _, winners = jobs.optimize(clean_daily(spark, sf), hash_rows, FULL_GRID)
    doubles = ("threshold", "profit_factor", "max_drawdown", "fitness", "production", "test_fitness")
    return rounded(winners, doubles, "symbol", "n_valid", "swing", "tp", "sl", "trade_count", "oos_sane")


# --- configuration sweep: all 53 slots under three formulations, in one job ------------


def whole_daily(spark, sf):
    """Daily bars of all orders as one market, once for each timeframe of the sweep: with ATR, positions from zero."""
    orders = fx.table(spark, sf, "orders").withColumn("o_orderstatus", F.lit("ALL"))
    bars = technicals(fx.daily_from(orders), ["atr_14"]).filter("atr_14 IS NOT NULL")
    bars = sweep.fan_out(bars.drop("timeframe", "rn", "n_bars", "n_trades"), F.lit(list(sweep.SWEEP_TIMEFRAMES)), "timeframe")
    return cut_lineage(with_position(bars.select("symbol", "timeframe", "ts", "open", "high", "low", "close", "volume", "atr_14"), last="close"))


def sweep_scorer(slices):
    wide = slices.withColumn("formulation", F.explode(F.lit(list(GRIDS))))
    return wide.withColumn("score", fx.md5_score(*[F.col(c) for c in ("symbol", "timeframe", "rn", "swing", "formulation")]))


_SWEEP_KEYS = ("timeframe", "swing", "tp", "sl", "formulation")
_SLOTS = f"""SELECT * FROM (VALUES {', '.join(f'({s})' for s in sweep.SWINGS)}) a(swing),
  (VALUES {', '.join(f'({tp}::DOUBLE, {sl}::DOUBLE)' for tp, sl in sweep.TP_SL_PAIRS)}) p(tp, sl), (VALUES ('4h'), ('1h')) t(timeframe)
  WHERE (swing, tp, sl, timeframe) NOT IN (SELECT * FROM (VALUES {', '.join(f"({s}, {tp}::DOUBLE, {sl}::DOUBLE, '{tf}')" for s, tp, sl, tf in sweep.EXCLUDED)}) x)"""


def sweep_ctes():
    bars = dict(op.atr("1d"))
    bars["b"] = bars["b"].replace("FROM bars_1d", "FROM bars_all")
    bars.pop("bars_1d")
    runs = run_ctes(_SWEEP_KEYS, GRIDS, swing="swing")
    runs["rk"] = f"SELECT 'ALL' AS symbol, slots.*, formulation FROM slots, (VALUES {', '.join(f'({f!r})' for f in GRIDS)}) f(formulation)"
    runs["win"] = runs["win"].replace("JOIN rk USING (symbol)", "JOIN rk USING (symbol, swing)")
    return {
        "bars_all": fx.SQL["bars_1d"].replace("o_orderstatus AS symbol", "'ALL' AS symbol"),
        **bars,
        "c": "SELECT * REPLACE (rn - 13 AS rn) FROM a WHERE atr_14 IS NOT NULL",
        "slots": _SLOTS,
        "x": "SELECT c.*, swing, tp, sl FROM c, (SELECT DISTINCT swing, tp, sl FROM slots)",
        "off": """SELECT x.swing, x.tp, x.sl, x.rn, min(f.rn - x.rn) FILTER (f.low <= x.close - x.atr_14 * x.sl) AS sl_off,
          min(f.rn - x.rn) FILTER (f.high >= x.close + x.atr_14 * x.tp) AS tp_off
          FROM x LEFT JOIN c f ON f.rn BETWEEN x.rn + 1 AND x.rn + x.swing GROUP BY ALL""",
        "lab": """SELECT x.*, CASE WHEN sl_off <= coalesce(tp_off, 1000000) THEN -1 WHEN tp_off IS NOT NULL THEN 1 ELSE 0 END AS target
          FROM x JOIN off USING (swing, tp, sl, rn)""",
        **{k: WF_CTES[k] for k in ("span", "r_f", "fw")},
        "bd": """SELECT f.symbol, s.swing, f.fold, f.start, f."end", count(*) FILTER (c.ts < f.start - to_days(s.swing)) AS n_prior,
          count(*) FILTER (c.ts < f.start) AS oos_lo, count(*) FILTER (c.ts < f."end") AS oos_hi
          FROM fw f JOIN c ON c.symbol = f.symbol, (SELECT DISTINCT swing FROM slots) s GROUP BY ALL""",
        "bz": "SELECT *, n_prior - swing AS alloc, greatest(16 * swing, floor((n_prior - swing) * 0.15::DOUBLE)::BIGINT) AS nv FROM bd",
        "bnd": """SELECT *, alloc - nv AS ntr, CASE WHEN n_prior < 200 + 17 * swing OR nv > alloc * 0.45::DOUBLE OR alloc - nv < 200
          OR oos_hi - oos_lo < 2 * swing THEN 'insufficient_prior_data' END AS skipped FROM bz""",
        "rg": """SELECT symbol, swing, fold, 'val' AS part, ntr + swing AS lo, ntr + swing + nv AS hi FROM bnd WHERE skipped IS NULL
          UNION ALL SELECT symbol, swing, fold, 'oos', oos_lo, oos_hi FROM bnd WHERE skipped IS NULL""",
        "sl0": """SELECT l.symbol, l.swing, l.tp, l.sl, g.fold, g.part, l.rn, l.rn - g.lo AS pos, l.ts, l.target, l.atr_14, l.close, x.close AS exit_close
          FROM rg g JOIN lab l ON l.swing = g.swing AND l.rn >= g.lo AND l.rn < g.hi JOIN c x ON x.rn = least(l.rn + g.swing, g.hi - 1)""",
        "sl": f"""SELECT s.*, r.timeframe, r.formulation, {op.md5_score('s.symbol', 'r.timeframe', 's.rn', 's.swing', 'r.formulation')} AS score
          FROM sl0 s JOIN (SELECT slots.*, formulation FROM slots, (VALUES {', '.join(f'({f!r})' for f in GRIDS)}) f(formulation)) r USING (swing, tp, sl)""",
        "sr": """SELECT *, CASE target WHEN 1 THEN atr_14 * tp / close WHEN -1 THEN -(atr_14 * sl / close) ELSE (exit_close - close) / close END AS ret FROM sl""",
        **runs,
    }


@query("config_sweep", with_sql(sweep_ctes(),
    f"""SELECT timeframe, swing, tp, sl, round(tp / sl, 3) AS rr, formulation, {op.r6('p5')} AS p5, {op.r6('p95')} AS p95, {op.r6('p95 - p5')} AS ci_width,
    pooled_trades, passes_gate, windows_used, windows_delta_gt_0 FROM run""", recursive=True))
def config_sweep(spark, sf):
    out = jobs.config_sweep(whole_daily(spark, sf), sweep_scorer, sweep.sweep_slots(spark), GRIDS)
    return rounded(out, ("p5", "p95", "ci_width"), *_SWEEP_KEYS, "rr", "pooled_trades", "passes_gate", "windows_used", "windows_delta_gt_0")


# --- regimes ---------------------------------------------------------------------------

REGIMES = (("bear", "1997-01-01", "1997-12-31"), ("range", "1998-01-01", "1998-12-31"), ("late", "1999-06-01", "2001-03-01"))


#: Counts that may be missing, as doubles.
_TRADE_COUNTS_SQL = "model_trades::DOUBLE AS model_trades, naive_trades::DOUBLE AS naive_trades"


def counted(out):
    return out.withColumns({c: F.col(c).cast("double") for c in ("model_trades", "naive_trades")})


def regime_ctes():
    from barloom.registry.trades_q import PRODUCTION_GRID, _search_ctes, draw_ctes

    values = ", ".join(f"('{name}', TIMESTAMP '{lo}', TIMESTAMP '{hi}')" for name, lo, hi in REGIMES)
    keys = "symbol, regime"
    floor = f"greatest(10, floor(greatest(1.0::DOUBLE, n_rows / {dbl(float(SWING))}) * 0.15::DOUBLE))"
    return {
        **C0,
        "tg": f"SELECT c0.*, regime, lo, hi, CASE WHEN lo <= TIMESTAMP '1998-06-01' THEN 'IN-SAMPLE' ELSE 'OOS' END AS sample_type FROM c0 JOIN (VALUES {values}) g(regime, lo, hi) ON c0.ts <= hi",
        "sz": """SELECT symbol, regime, sample_type, count(*) FILTER (ts >= lo) AS n_bars, count(*) FILTER (ts < lo) AS n_prior FROM tg GROUP BY ALL""",
        "st": """SELECT *, CASE WHEN n_bars < 200 THEN 'insufficient_data' WHEN n_prior < 500 THEN 'insufficient_prior' END AS status,
          greatest(200, floor(n_prior * 0.15::DOUBLE)) AS n_val FROM sz""",
        **op.labels("c0", SWING),
        "pt": """SELECT l.*, t.regime, CASE WHEN l.ts >= t.lo THEN 'window' WHEN l.rn >= s.n_prior - s.n_val THEN 'val' END AS part
          FROM lab l JOIN tg t ON t.symbol = l.symbol AND t.rn = l.rn JOIN st s ON s.symbol = l.symbol AND s.regime = t.regime WHERE s.status IS NULL""",
        "pp": f"""SELECT * REPLACE (coalesce(lead(close, {SWING}) OVER w, last(close) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS exit_close),
          row_number() OVER w - 1 AS pos, {_HASH_SQL} AS score FROM pt WHERE part IS NOT NULL WINDOW w AS (PARTITION BY symbol, regime, part ORDER BY rn)""",
        "sc0": f"SELECT *, {op.binary()} AS ret, {op.ternary()} AS ret_val FROM pp",
        "vl": "SELECT * FROM sc0 WHERE part = 'val'",
        **_search_ctes("vl", ["symbol", "regime"], PRODUCTION_GRID, floor, "ret_val"),
        "wi": "SELECT s.*, b.threshold FROM sc0 s JOIN best b USING (symbol, regime) WHERE part = 'window'",
        "mc": "SELECT * FROM wi WHERE score >= threshold",
        **op.picks("mc", ["symbol", "regime"], SWING, "r_mp"),
        "tt": f"""SELECT symbol, regime, 'model' AS side, pos, ret FROM mc JOIN r_mp USING (symbol, regime, pos)
          UNION ALL SELECT symbol, regime, 'naive', pos, ret FROM wi WHERE pos % {SWING} = 0""",
        "sm0": f"""SELECT {keys}, count(*) FILTER (side = 'model') AS model_trades, count(*) FILTER (side = 'naive') AS naive_trades,
          coalesce(sum(ret) FILTER (side = 'model' AND ret > 0), 0) AS mg, coalesce(sum(-ret) FILTER (side = 'model' AND ret < 0), 0) AS ml,
          coalesce(sum(ret) FILTER (side = 'naive' AND ret > 0), 0) AS ng, coalesce(sum(-ret) FILTER (side = 'naive' AND ret < 0), 0) AS nl FROM tt GROUP BY {keys}""",
        "pfs": f"SELECT *, {op.pf('mg', 'ml', 'model_trades')} AS model_pf, {op.pf('ng', 'nl', 'naive_trades')} AS naive_pf FROM sm0",
        "ix": f"""SELECT t.*, row_number() OVER (PARTITION BY {keys}, side ORDER BY pos) - 1 AS idx, count(*) OVER (PARTITION BY {keys}, side) AS n
          FROM tt t SEMI JOIN (SELECT p.* FROM pfs p JOIN sz USING (symbol, regime) WHERE sample_type = 'OOS' AND model_trades >= 20 AND naive_trades >= 20) e USING (symbol, regime)""",
        "dw": f"""SELECT {keys}, side, iteration, CAST('0x' || substr(md5('42|' || side || '|' || iteration || '|' || idx), 1, 8) AS BIGINT) % n AS idx
          FROM ix, range(1000) g(iteration)""",
        "sm": f"""SELECT {keys}, d.iteration, coalesce(sum(ret) FILTER (side = 'model' AND ret > 0), 0) AS mg, coalesce(sum(-ret) FILTER (side = 'model' AND ret < 0), 0) AS ml,
          coalesce(sum(ret) FILTER (side = 'naive' AND ret > 0), 0) AS ng, coalesce(sum(-ret) FILTER (side = 'naive' AND ret < 0), 0) AS nl,
          count(*) FILTER (side = 'model') AS mn, count(*) FILTER (side = 'naive') AS nn FROM dw d JOIN ix USING (symbol, regime, side, idx) GROUP BY ALL""",
        "dl": f"SELECT {keys}, iteration, {op.pf('mg', 'ml', 'mn')} - {op.pf('ng', 'nl', 'nn')} AS delta FROM sm",
        "ct": draw_ctes(keys)["ct"],
        "mk0": """SELECT symbol, regime, rn, close, close / nullif(lag(close) OVER (PARTITION BY symbol, regime ORDER BY rn), 0) - 1 AS r FROM tg WHERE ts >= lo""",
        "mk": """SELECT symbol, regime, 100 * (arg_max(close, rn) / arg_min(close, rn) - 1) AS cum_return_pct, 100 * stddev_samp(r) AS ret_std_pct FROM mk0 GROUP BY ALL""",
        "rr": """SELECT s.*  REPLACE (CASE WHEN status IS NULL AND b.threshold IS NULL THEN 'threshold_failed' ELSE status END AS status), b.threshold, model_trades, naive_trades, model_pf, naive_pf,
          model_pf - naive_pf AS delta, CASE WHEN n_null = 0 THEN p5 END AS p5, CASE WHEN n_null = 0 THEN p50 END AS p50, CASE WHEN n_null = 0 THEN p95 END AS p95, cum_return_pct, ret_std_pct
          FROM st s LEFT JOIN best b USING (symbol, regime) LEFT JOIN pfs USING (symbol, regime) LEFT JOIN ct USING (symbol, regime) LEFT JOIN mk USING (symbol, regime)""",
    }


_REGIME_DOUBLES = ("threshold", "model_pf", "naive_pf", "delta", "p5", "p50", "p95", "cum_return_pct", "ret_std_pct")


@query("regimes_rigorous", with_sql(regime_ctes(),
    f"SELECT {rounded_sql(_REGIME_DOUBLES, 'symbol', 'regime', 'sample_type', 'n_bars', 'n_prior', 'status')}, {_TRADE_COUNTS_SQL} FROM rr", recursive=True))
def regimes_rigorous(spark, sf):
    labelled = barrier_labels(clean_daily(spark, sf))
    out = jobs.regimes(labelled, REGIMES, hash_rows, SWING, 1.5, 1.0, in_sample_end="1998-06-01", n_iter=1000)
    return rounded(counted(out), _REGIME_DOUBLES, "symbol", "regime", "sample_type", "n_bars", "n_prior", "status", "model_trades", "naive_trades")


# --- two formulations side by side -------------------------------------------------------

PAIR = {name: GRIDS[name] for name in ("binary_homerun", "multiclass_3")}


def pair_scorer(df):
    wide = df.withColumn("formulation", F.explode(F.lit(list(PAIR))))
    return wide.withColumn("score", fx.md5_score(F.col("symbol"), F.date_format("ts", "yyyy-MM-dd"), F.col("formulation")))


def pair_ctes():
    from barloom.registry.trades_q import _search_ctes, draw_ctes

    keys = "symbol, formulation, split"
    regime = regime_ctes()
    floor = f"greatest(10, floor(greatest(1.0::DOUBLE, n_rows / {dbl(float(SWING))}) * 0.15::DOUBLE))"
    whole = split_eval_ctes(SWING, SWING)
    moved = lambda body: body.replace("symbol, regime", keys)
    return {
        **{k: v for k, v in {**C0, **whole}.items() if k in C0 or k in ("n", "z", "ok", "lab", "lab_off", "lab_t", "s")},
        "h": f"""SELECT * EXCLUDE (exit_close), formulation, row_number() OVER w - 1 AS pos, {op.md5_score('symbol', "strftime(ts, '%Y-%m-%d')", 'formulation')} AS score,
          coalesce(lead(close, {SWING}) OVER w, last(close) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS exit_close
          FROM s, (VALUES ('binary_homerun'), ('multiclass_3')) f(formulation) WHERE split IS NOT NULL WINDOW w AS (PARTITION BY symbol, formulation, split ORDER BY rn)""",
        "e": f"SELECT *, {op.ternary()} AS ret FROM h",
        "vl": "SELECT * FROM e WHERE split = 'val'",
        **_search_ctes("vl", ["symbol", "formulation"], PAIR, floor, "ret"),
        "wi": "SELECT e.*, b.threshold FROM e JOIN best b USING (symbol, formulation)",
        "mc": "SELECT * FROM wi WHERE score >= threshold",
        **op.picks("mc", ["symbol", "formulation", "split"], SWING, "r_mp"),
        "tt": moved(regime["tt"]),
        "sm0": moved(regime["sm0"]),
        "pfs": regime["pfs"],
        "ix": f"""SELECT t.*, row_number() OVER (PARTITION BY {keys}, side ORDER BY pos) - 1 AS idx, count(*) OVER (PARTITION BY {keys}, side) AS n
          FROM tt t SEMI JOIN (SELECT * FROM pfs WHERE model_trades >= 20 AND naive_trades >= 20) x USING ({keys})""",
        **{k: moved(regime[k]) for k in ("dw", "sm", "dl")},
        "ct": draw_ctes(keys)["ct"],
        "qs": f"""SELECT {keys}, quantile_cont(score, 0.1) AS score_p10, quantile_cont(score, 0.5) AS score_p50, quantile_cont(score, 0.9) AS score_p90, max(score) AS score_max
          FROM e GROUP BY {keys}""",
        "rr": f"""SELECT q.*, b.threshold, model_trades, naive_trades, model_pf, naive_pf, model_pf - naive_pf AS delta,
          CASE WHEN n_null = 0 THEN p5 END AS p5, CASE WHEN n_null = 0 THEN p50 END AS p50, CASE WHEN n_null = 0 THEN p95 END AS p95
          FROM qs q LEFT JOIN best b USING (symbol, formulation) LEFT JOIN pfs USING ({keys}) LEFT JOIN ct USING ({keys})""",
    }


_PAIR_DOUBLES = ("threshold", "model_pf", "naive_pf", "delta", "p5", "p50", "p95", "score_p10", "score_p50", "score_p90", "score_max")


@query("binary_vs_multiclass", with_sql(pair_ctes(),
    f"SELECT {rounded_sql(_PAIR_DOUBLES, 'symbol', 'formulation', 'split')}, {_TRADE_COUNTS_SQL} FROM rr", recursive=True))
def binary_vs_multiclass(spark, sf):
    out = jobs.compare_formulations(barrier_labels(clean_daily(spark, sf)), pair_scorer, SWING, 1.5, 1.0, PAIR)
    return rounded(counted(out), _PAIR_DOUBLES, "symbol", "formulation", "split", "model_trades", "naive_trades")


# --- models ------------------------------------------------------------------------------

def model_data(spark, sf):
    """Labelled daily bars with all technicals, no missing rows, positions from zero."""
    bars = technicals(fx.bars(spark, sf, "1d"))
    labelled = clean(barrier_labels(bars).drop("rn", "n_bars", "last_close"), (*DATASET_DROP, "n_trades"))
    return with_position(labelled, last="close"), infer_features(labelled)


@query("gbt_baseline")
def gbt_baseline(spark, sf):
    """All three formulations on daily bars: boosted trees per fold on all technicals, as the default experiment has it."""
    config = ExperimentConfig()
    dataset, features = model_data(spark, sf)
    ready, bounds = wf.prepare(dataset, config)
    scorer = models.model_scorer(ready, bounds, {"CONTROL": features})
    grids = {f.name: f.thresholds for f in FORMULATIONS.values()}
    out = wf.evaluate(ready, bounds, scorer, config, grids, models.RUN_KEYS, ("target_ret", *features))
    return rounded(out.runs, RUN_DOUBLES, "symbol", "variant", "formulation", *RUN_COUNTS, "passes_gate")


@query("production_training")
def production_training(spark, sf):
    """Final models of every series for each strategy of the search, as a table of models."""
    dataset, features = model_data(spark, sf)
    sets = {r["name"]: [f for f in r["features"] if f in features] for r in strategies(dataset, with_sentiment=False).collect()}
    out = models.production_models(dataset, sets)
    return out.select("symbol", F.col("variant").alias("strategy"), "kept", F.round("loss", 6).alias("loss"), F.size("leaf").alias("n_leaves"))


@query("model_evaluation")
def model_evaluation(spark, sf):
    """Fitted models on validation and test: threshold, trades against naive, precision of the signals."""
    dataset, features = model_data(spark, sf)
    dataset = cut_lineage(dataset)
    out = jobs.naive_vs_model(dataset, models.split_scorer(dataset, features, SWING), SWING, 1.5, 1.0)
    doubles = ("threshold", "naive_profit_factor", "model_profit_factor", "delta", "precision")
    return rounded(out, doubles, "symbol", "split", "naive_trade_count", "model_trade_count", "signals", "hits")
