"""Queries on trades, thresholds, metrics, folds, bootstrap and gates.

Scores come from a hash of (symbol, timeframe, position), so the oracles can
recompute them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.keys import r6
from barloom.operators import bootstrap as boot
from barloom.operators import metrics as mx
from barloom.operators import trades as tr
from barloom.operators.folds import fold_bounds, fold_windows
from barloom.operators.labels import barrier_labels
from barloom.operators.layout import with_position
from barloom.plans import walkforward as wf
from barloom.plans.config import ExperimentConfig
from barloom.registry import fixtures as fx
from barloom.registry import oracle_parts as op
from barloom.registry.core import query
from barloom.registry.features_q import rounded, rounded_sql
from barloom.registry.labels_q import atr_bars
from barloom.registry.oracle_parts import dbl, with_sql
from barloom.session import cut_lineage

SWING = 10
COST = tr.round_trip_cost(0.001, 0.0005)
KEYS = ["symbol", "timeframe"]
SCORE = op.md5_score("symbol", "timeframe", "pos")


def evaluated(spark, sf, tf="1h"):
    """Labelled bars without warm-up rows: position in the clean series, score, exit close."""
    clean = barrier_labels(atr_bars(spark, sf, tf)).filter("atr_14 IS NOT NULL")
    # Warm-up rows are a prefix, so positions only shift.
    shifted = clean.withColumn("pos", F.col("rn") - 13)
    out = tr.with_exit_close(shifted, SWING, KEYS, "pos").withColumn("exit_close", F.coalesce("close_ahead", "last_close"))
    scored = out.withColumn("score", fx.md5_score(F.col("symbol"), F.col("timeframe"), F.col("pos")))
    return cut_lineage(scored)


def evaluated_sql(tf="1h"):
    return {
        **op.atr(tf),
        **op.labels("a"),
        "c": "SELECT *, rn - 13 AS pos FROM lab WHERE atr_14 IS NOT NULL",
        "ev": f"""SELECT *, {SCORE} AS score, {op.ternary()} AS ret0, {op.ternary(cost=COST)} AS ret_net, {op.binary()} AS ret_bin FROM c""",
    }


EV_COLS = ("ret0", "ret_net", "ret_bin")


def priced(spark, sf, tf="1h"):
    out = evaluated(spark, sf, tf)
    ret = lambda **kw: tr.trade_return(1.5, 1.0, F.col("exit_close"), **kw)
    return out.withColumns({"ret0": ret(), "ret_net": ret(cost=COST), "ret_bin": ret(payoff="binary")})


def _pf_sql(source, keys, ret):
    return f"""SELECT {keys}, count(*) AS trades, {op.r6(op.pf(f'coalesce(sum({ret}) FILTER ({ret} > 0), 0)', f'coalesce(sum(-{ret}) FILTER ({ret} < 0), 0)', 'count(*)'))} AS profit_factor,
    {op.r6(f'sum({ret})')} AS net FROM {source} GROUP BY {keys}"""


@query("naive_trades", with_sql(
    {**evaluated_sql("4h"), "t": f"SELECT * FROM ev WHERE pos % {SWING} = 0"}, _pf_sql("t", "symbol", "ret0"), recursive=True))
def naive_trades(spark, sf):
    trades = tr.naive_trades(priced(spark, sf, "4h"), SWING)
    sums = trades.groupBy("symbol").agg(*mx.signed_sums("ret0"), F.sum("ret0").alias("net"))
    pf = mx.profit_factor(F.col("gain"), F.col("loss"), F.col("trades"))
    return sums.select("symbol", "trades", r6(pf).alias("profit_factor"), r6(F.col("net")).alias("net"))


def _model_sql(thr=0.6):
    return {
        **evaluated_sql(),
        "cand": f"SELECT * FROM ev WHERE score >= {dbl(thr)}",
        **op.picks("cand", ["symbol"], SWING),
        "t": "SELECT c.* FROM cand c JOIN r_pick p ON p.symbol = c.symbol AND p.pos = c.pos",
    }


def model_trades(spark, sf, ret="ret_net", thr=0.6, rows=None):
    rows = priced(spark, sf) if rows is None else rows
    gain, loss = tr.gain_and_loss(F.col(ret), F.col("target"))
    rows = rows.withColumns({"gain": gain, "loss": loss})
    return tr.cooldown_select(rows.filter(F.col("score") >= thr), KEYS, SWING, ["ts", "target", ret, "gain", "loss"])


@query("cooldown_trades", with_sql(_model_sql(), f"SELECT symbol, ts, pos, target, {op.r6('ret_net')} AS ret FROM t", recursive=True))
def cooldown_trades(spark, sf):
    return model_trades(spark, sf).select("symbol", "ts", "pos", "target", r6(F.col("ret_net")).alias("ret"))


def _metrics_ctes(source, ret):
    return {
        "eq": f"""SELECT *, {ret} AS r, product(1 + {ret}) OVER (PARTITION BY symbol ORDER BY pos) AS equity FROM {source}""",
        "pk": "SELECT *, greatest(1, max(equity) OVER (PARTITION BY symbol ORDER BY pos)) AS peak FROM eq",
        "mt": f"""SELECT symbol, count(*) AS trade_count,
          sum(CASE target WHEN 1 THEN r WHEN -1 THEN 0 ELSE greatest(r, 0) END) AS gross_profit,
          sum(CASE target WHEN -1 THEN abs(r) WHEN 1 THEN 0 ELSE greatest(-r, 0) END) AS gross_loss,
          greatest(0, max((peak - equity) / peak)) AS max_drawdown FROM pk GROUP BY symbol""",
        "tm": "SELECT *, gross_profit / greatest(gross_loss, 1e-9::DOUBLE) AS profit_factor FROM mt",
    }


METRIC_COLS = ("gross_profit", "gross_loss", "profit_factor", "max_drawdown")


@query("trade_metrics", with_sql({**_model_sql(), **_metrics_ctes("t", "ret_net")},
    f"SELECT {rounded_sql(METRIC_COLS, 'symbol', 'trade_count')} FROM tm", recursive=True))
def trade_metrics(spark, sf):
    out = mx.trade_metrics(model_trades(spark, sf), KEYS, ret="ret_net")
    return rounded(out, METRIC_COLS, "symbol", "trade_count")


@query("max_drawdown", with_sql({**evaluated_sql(), "t": f"SELECT * FROM ev WHERE pos % {SWING} = 0", **_metrics_ctes("t", "ret_bin")},
    f"SELECT {rounded_sql(('max_drawdown',), 'symbol', 'trade_count')} FROM tm", recursive=True))
def max_drawdown(spark, sf):
    naive = tr.naive_trades(priced(spark, sf), SWING)
    gain, loss = tr.gain_and_loss(F.col("ret_bin"), F.col("target"))
    out = mx.trade_metrics(naive.withColumns({"gain": gain, "loss": loss}), KEYS, ret="ret_bin")
    return rounded(out, ("max_drawdown",), "symbol", "trade_count")


_FITNESS = f"""CASE WHEN profit_factor <= 1 THEN -999.0::DOUBLE ELSE (least(profit_factor, 10) - 1) / greatest(max_drawdown, 0.01::DOUBLE)
  * ln(greatest(trade_count, 1)) * least(1.0::DOUBLE, trade_count / greatest(12, floor(greatest(1.0::DOUBLE, n / {dbl(10.0)}) * 0.15::DOUBLE))) END"""
_PRODUCTION = """CASE WHEN trade_count < 12 OR profit_factor <= 1.05::DOUBLE THEN -9999.0::DOUBLE + trade_count
  ELSE (profit_factor - 1) / greatest(max_drawdown, 0.01::DOUBLE) * ln(trade_count) END"""


@query("fitness_score", with_sql({**_model_sql(), **_metrics_ctes("t", "ret0"),
    "sz": "SELECT symbol, count(*) AS n FROM ev GROUP BY symbol"},
    f"SELECT symbol, {op.r6(_FITNESS)} AS fitness, {op.r6(_PRODUCTION)} AS production FROM tm JOIN sz USING (symbol)", recursive=True))
def fitness_score(spark, sf):
    rows = priced(spark, sf)
    gain, loss = tr.gain_and_loss(F.col("ret0"), F.col("target"))
    rows = rows.withColumns({"gain": gain, "loss": loss})
    picks = tr.cooldown_select(rows.filter(F.col("score") >= 0.6), KEYS, SWING, ["target", "ret0", "gain", "loss"])
    out = mx.trade_metrics(picks, KEYS, ret="ret0").join(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")), KEYS)
    fit = mx.fitness_score(F.col("n"), F.lit(float(SWING)))
    return out.select("symbol", r6(fit).alias("fitness"), r6(mx.production_score(12)).alias("production"))


PRODUCTION_GRID = tr.threshold_grid(*tr.BINARY_GRID, inclusive=False)
WALK_GRID = tr.threshold_grid(*tr.BINARY_GRID)


def _search_ctes(source, keys, grid, floor, ret, swing=SWING):
    k = ", ".join(keys)
    if isinstance(grid, dict):
        values = ", ".join(f"('{name}', {dbl(t)})" for name, ts in grid.items() for t in ts)
        head, match = "g(grid_name, threshold)", "score >= threshold AND formulation = grid_name"
    else:
        values = ", ".join(f"({dbl(t)})" for t in grid)
        head, match = "g(threshold)", "score >= threshold"
    on = " AND ".join(f"p.{x} = c.{x}" for x in [*keys, "threshold"])
    return {
        "grid": f"SELECT * FROM (VALUES {values}) {head}",
        "sc": f"SELECT {k}, pos, {ret} AS ret, threshold FROM {source} JOIN grid ON {match}",
        **op.picks("sc", [*keys, "threshold"], swing, "r_sp"),
        "nets": f"""SELECT {', '.join('c.' + x for x in keys)}, c.threshold, sum(c.ret) AS net, count(*) AS n_trades
          FROM sc c JOIN r_sp p ON {on} AND p.pos = c.pos GROUP BY ALL""",
        "runs": f"SELECT {k}, count(*) AS n_rows FROM {source} GROUP BY ALL",
        "best": f"""SELECT nets.* FROM nets JOIN runs USING ({k}) WHERE n_trades >= {floor}
          QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY round(net, 12) DESC, threshold) = 1""",
    }


@query("threshold_search", with_sql(
    {**evaluated_sql(), **_search_ctes("ev", ["symbol"], PRODUCTION_GRID,
     f"greatest(10, floor(greatest(1.0::DOUBLE, n_rows / {dbl(float(SWING))}) * 0.15::DOUBLE))", "ret_net")},
    f"""SELECT runs.symbol, {op.r6('threshold')} AS threshold, {op.r6('net')} AS net, n_trades::DOUBLE AS n_trades
    FROM runs LEFT JOIN best USING (symbol)""", recursive=True))
def threshold_search(spark, sf):
    rows = priced(spark, sf)
    out = tr.threshold_search(rows, KEYS, SWING, PRODUCTION_GRID, tr.production_min_trades(SWING), ret="ret_net")
    return out.select("symbol", r6(F.col("threshold")).alias("threshold"), r6(F.col("net")).alias("net"), F.col("n_trades").cast("double").alias("n_trades"))


# --- walk-forward on daily bars ------------------------------------------------

CONFIG = ExperimentConfig()


def wf_bars(spark, sf):
    """Clean labelled daily bars, positions counted from the first one kept."""
    clean = barrier_labels(atr_bars(spark, sf, "1d"), CONFIG.barrier).filter("atr_14 IS NOT NULL")
    return clean.withColumn("rn", F.col("rn") - 13).drop("n_bars")


WF_CTES = {
    **op.atr("1d"),
    **op.labels("a"),
    "c": f"SELECT * REPLACE (rn - 13 AS rn) FROM lab WHERE atr_14 IS NOT NULL",
    "span": "SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM c GROUP BY symbol",
    "r_f": """SELECT symbol, 0::BIGINT AS fold, lo + INTERVAL 6 MONTHS AS start FROM span
      UNION ALL SELECT f.symbol, f.fold + 1, f.start + INTERVAL 6 MONTHS FROM r_f f JOIN span s ON s.symbol = f.symbol AND f.start < s.hi""",
    "fw": """SELECT f.symbol, f.fold, f.start, f.start + INTERVAL 6 MONTHS AS "end" FROM r_f f JOIN span s ON s.symbol = f.symbol
      WHERE f.start < s.hi AND f.start + INTERVAL 6 MONTHS <= s.hi""",
    "bd": """SELECT f.symbol, f.fold, f.start, f."end", count(*) FILTER (c.ts < f.start - INTERVAL 10 DAYS) AS n_prior,
      count(*) FILTER (c.ts < f.start) AS oos_lo, count(*) FILTER (c.ts < f."end") AS oos_hi
      FROM fw f JOIN c ON c.symbol = f.symbol GROUP BY ALL""",
    "bz": "SELECT *, n_prior - 10 AS alloc, greatest(400, floor((n_prior - 10) * 0.15::DOUBLE)::BIGINT) AS nv FROM bd",
    "bnd": """SELECT *, alloc - nv AS ntr, CASE WHEN n_prior < 200 + 400 + 10 OR nv > alloc * 0.45::DOUBLE OR alloc - nv < 200
      OR oos_hi - oos_lo < 20 THEN 'insufficient_prior_data' END AS skipped FROM bz""",
    "rg": """SELECT symbol, fold, 'val' AS part, ntr + 10 AS lo, ntr + 10 + nv AS hi FROM bnd WHERE skipped IS NULL
      UNION ALL SELECT symbol, fold, 'oos', oos_lo, oos_hi FROM bnd WHERE skipped IS NULL""",
    "sl": f"""SELECT c.symbol, g.fold, g.part, c.rn - g.lo AS pos, c.ts, c.target, c.atr_14, c.close, x.close AS exit_close,
      {op.md5_score('c.symbol', 'c.timeframe', 'c.rn')} AS score
      FROM rg g JOIN c ON c.symbol = g.symbol AND c.rn >= g.lo AND c.rn < g.hi
      JOIN c x ON x.symbol = c.symbol AND x.rn = least(c.rn + 10, g.hi - 1)""",
    "sr": f"SELECT *, {op.ternary()} AS ret FROM sl",
}


def run_ctes(extra=(), grid=WALK_GRID, seed="42", swing=SWING):
    """Threshold, trades, windows, bootstrap and gate for runs (symbol, *extra) over slices ``sr``.

    ``swing`` is a number, or "swing" where it is a key column.
    """
    cooldown = f"c.{swing}" if isinstance(swing, str) else swing
    keys = ["symbol", *extra]
    k, kf = ", ".join(keys), ", ".join([*keys, "fold"])
    return {
        "vs": "SELECT * FROM sr WHERE part = 'val'",
        **_search_ctes("vs", [*keys, "fold"], grid, "8", "ret", cooldown),
        "oos": f"SELECT s.*, b.threshold FROM sr s JOIN best b USING ({kf}) WHERE part = 'oos'",
        "oc": "SELECT * FROM oos WHERE score >= threshold",
        **op.picks("oc", [*keys, "fold"], cooldown, "r_op"),
        "tr": f"""SELECT {kf}, 'model' AS side, pos, c.ts, c.ret FROM oc c JOIN r_op p USING ({kf}, pos)
          UNION ALL SELECT {kf}, 'naive', pos, ts, ret FROM oos WHERE pos % {swing} = 0""",
        "ws": f"""SELECT {kf}, coalesce(sum(ret) FILTER (side = 'model'), 0) AS cum_ret, coalesce(stddev_pop(ret) FILTER (side = 'model'), 0) AS vol,
          coalesce(sum(ret) FILTER (side = 'model' AND ret > 0), 0) AS mg, coalesce(sum(-ret) FILTER (side = 'model' AND ret < 0), 0) AS ml,
          coalesce(sum(ret) FILTER (side = 'naive' AND ret > 0), 0) AS ng, coalesce(sum(-ret) FILTER (side = 'naive' AND ret < 0), 0) AS nl,
          count(*) FILTER (side = 'model') AS mn, count(*) FILTER (side = 'naive') AS nn FROM tr GROUP BY ALL""",
        "rk": f"SELECT DISTINCT {k} FROM vs" if extra else "SELECT DISTINCT symbol FROM bnd",
        "win": f"""SELECT {kf}, start, "end", coalesce(b.skipped, CASE WHEN t.threshold IS NULL THEN 'threshold_failed' END) AS skipped_reason,
          coalesce(cum_ret, 0) AS cum_ret, coalesce(vol, 0) AS vol, coalesce(t.threshold, 0) AS threshold,
          CASE WHEN t.threshold IS NULL THEN 0 ELSE {op.pf('mg', 'ml', 'mn')} END AS model_pf,
          CASE WHEN t.threshold IS NULL THEN 0 ELSE {op.pf('ng', 'nl', 'nn')} END AS naive_pf,
          coalesce(mn, 0) AS model_trade_count, coalesce(nn, 0) AS naive_trade_count, coalesce(mg, 0) AS mg, coalesce(ml, 0) AS ml
          FROM bnd b JOIN rk USING (symbol) LEFT JOIN best t USING ({kf}) LEFT JOIN ws w USING ({kf})""",
        "us": f"""SELECT {kf}, start, "end", (row_number() OVER (PARTITION BY {k} ORDER BY fold) - 1) * 8 AS block0 FROM win WHERE skipped_reason IS NULL""",
        "bk": f"""SELECT {k}, u.block0 + floor((epoch_us(t.ts) - epoch_us(u.start)) * 8 / (epoch_us(u."end") - epoch_us(u.start)))::BIGINT AS block,
          coalesce(sum(ret) FILTER (side = 'model' AND ret > 0), 0) AS mg, coalesce(sum(-ret) FILTER (side = 'model' AND ret < 0), 0) AS ml,
          count(*) FILTER (side = 'model') AS mn, coalesce(sum(ret) FILTER (side = 'naive' AND ret > 0), 0) AS ng,
          coalesce(sum(-ret) FILTER (side = 'naive' AND ret < 0), 0) AS nl, count(*) FILTER (side = 'naive') AS nn
          FROM us u JOIN tr t USING ({kf}) GROUP BY ALL""",
        **draw_ctes(k, seed),
        "rn_": f"""SELECT {k}, count(*) AS total_windows, count(*) FILTER (skipped_reason IS NULL) AS windows_used,
          count(*) FILTER (skipped_reason IS NULL AND model_pf > 1) AS windows_pf_gt_1,
          count(*) FILTER (skipped_reason IS NULL AND round(model_pf - naive_pf, 12) > 0) AS windows_delta_gt_0,
          count(*) FILTER (skipped_reason IS NOT NULL) AS windows_skipped, sum(model_trade_count)::BIGINT AS pooled_trades,
          {op.pf('sum(mg)', 'sum(ml)', 'sum(model_trade_count)')} AS oos_pf_point FROM win GROUP BY {k}""",
        "run": f"""SELECT r.*, CASE WHEN n_null = 0 THEN p5 END AS p5, CASE WHEN n_null = 0 THEN p50 END AS p50, CASE WHEN n_null = 0 THEN p95 END AS p95,
          coalesce(pooled_trades >= 300 AND n_null = 0 AND p5 > 0, false) AS passes_gate FROM rn_ r LEFT JOIN ct USING ({k})""",
    }


def draw_ctes(k="symbol", seed="42"):
    """Paired block draws over ``us`` and ``bk``."""
    return {
        "kk": f"SELECT {k}, max(block0) + 8 AS k FROM us GROUP BY {k}",
        "dr": f"""SELECT {k}, i.iteration, CAST('0x' || substr(md5({seed} || '|' || i.iteration || '|' || j.draw), 1, 8) AS BIGINT) % k AS block
          FROM kk, range(1000) i(iteration), range(2000) j(draw) WHERE j.draw < k""",
        "dl": f"""SELECT {k}, d.iteration, {op.pf('sum(mg)', 'sum(ml)', 'sum(mn)')} - {op.pf('sum(ng)', 'sum(nl)', 'sum(nn)')} AS delta
          FROM dr d LEFT JOIN bk USING ({k}, block) GROUP BY ALL""",
        "ct": f"""SELECT {k}, count(*) FILTER (delta IS NULL) AS n_null, quantile_cont(delta, 0.05) AS p5, quantile_cont(delta, 0.5) AS p50,
          quantile_cont(delta, 0.95) AS p95 FROM dl GROUP BY {k}""",
    }


BASE_CTES = WF_CTES
WF_CTES = {**BASE_CTES, **run_ctes()}


def _upto(name):
    """The walk-forward CTEs up to and including ``name``."""
    out = {}
    for key, body in WF_CTES.items():
        out[key] = body
        if key == name:
            return out
    raise KeyError(name)


@query("walkforward_folds", with_sql(_upto("fw"), 'SELECT symbol, fold, start, "end" FROM fw', recursive=True))
def walkforward_folds(spark, sf):
    return fold_windows(wf_bars(spark, sf), 6, 6).select("symbol", F.col("fold").cast("long").alias("fold"), "start", "end")


@query("fold_bounds", with_sql(_upto("bnd"),
    """SELECT symbol, fold, n_prior, CASE WHEN skipped IS NULL THEN ntr ELSE -1 END AS n_train,
    CASE WHEN skipped IS NULL THEN ntr + 10 ELSE -1 END AS val_lo, CASE WHEN skipped IS NULL THEN ntr + 10 + nv ELSE -1 END AS val_hi,
    oos_lo, oos_hi, skipped AS skipped_reason FROM bnd""", recursive=True))
def fold_bounds_q(spark, sf):
    bars = cut_lineage(wf_bars(spark, sf))
    out = fold_bounds(bars, fold_windows(bars, 6, 6), SWING)
    return out.select("symbol", F.col("fold").cast("long").alias("fold"), "n_prior",
                      *[F.when(F.col("skipped_reason").isNull(), F.col(c)).otherwise(-1).cast("long").alias(c) for c in ("n_train", "val_lo", "val_hi")],
                      "oos_lo", "oos_hi", "skipped_reason")


def hash_scorer(slices):
    return slices.withColumn("score", fx.md5_score(F.col("symbol"), F.col("timeframe"), F.col("rn")))


def walk(spark, sf):
    ready, bounds = wf.prepare(wf_bars(spark, sf), CONFIG)
    return wf.evaluate(ready, bounds, hash_scorer, CONFIG, WALK_GRID)


WINDOW_DOUBLES = ("cum_ret", "vol", "threshold", "model_pf", "naive_pf", "delta")


@query("walkforward_eval", with_sql(_upto("win"),
    f"""SELECT symbol, fold, start, "end", skipped_reason, {op.r6('cum_ret')} AS cum_ret, {op.r6('vol')} AS vol, {op.r6('threshold')} AS threshold,
    {op.r6('model_pf')} AS model_pf, {op.r6('naive_pf')} AS naive_pf, {op.r6('model_pf - naive_pf')} AS delta, model_trade_count, naive_trade_count FROM win""",
    recursive=True))
def walkforward_eval(spark, sf):
    out = walk(spark, sf).windows.withColumn("fold", F.col("fold").cast("long"))
    return rounded(out, WINDOW_DOUBLES, "symbol", "fold", "start", "end", "skipped_reason", "model_trade_count", "naive_trade_count")


RUN_COUNTS = ("total_windows", "windows_used", "windows_pf_gt_1", "windows_delta_gt_0", "windows_skipped", "pooled_trades")


@query("gate", with_sql(_upto("run"),
    f"SELECT symbol, {', '.join(RUN_COUNTS)}, {op.r6('oos_pf_point')} AS oos_pf_point, {op.r6('p5')} AS p5, {op.r6('p95')} AS p95, passes_gate FROM run",
    recursive=True))
def gate(spark, sf):
    return rounded(walk(spark, sf).runs, ("oos_pf_point", "p5", "p95"), "symbol", *RUN_COUNTS, "passes_gate")


# --- bootstrap on the 1h trades: windows of ten days ----------------------------

_BOOT_CTES = {
    **_model_sql(0.5),
    "tt": """SELECT symbol, 'model' AS side, ts, ret_net AS ret, pos FROM t
      UNION ALL SELECT symbol, 'naive', ts, ret_net, pos FROM ev WHERE pos % 10 = 0""",
}


def boot_trades(spark, sf):
    rows = priced(spark, sf)
    model = model_trades(spark, sf, thr=0.5, rows=rows).select(*KEYS, F.lit("model").alias("side"), "ts", F.col("ret_net").alias("ret"), "pos")
    naive = tr.naive_trades(rows, SWING).select(*KEYS, F.lit("naive").alias("side"), "ts", F.col("ret_net").alias("ret"), "pos")
    return cut_lineage(model.unionByName(naive))


@query("paired_block_bootstrap", with_sql(
    {**_BOOT_CTES,
     "us": """SELECT symbol, i AS fold, TIMESTAMP '2024-01-01' + to_days((i * 10)::INT) AS start, TIMESTAMP '2024-01-01' + to_days((i * 10 + 10)::INT) AS "end", i * 8 AS block0
       FROM (SELECT symbol, max(date_diff('day', TIMESTAMP '2024-01-01', ts)) // 10 AS last FROM tt GROUP BY symbol), range(1000) g(i) WHERE i <= last""",
     "bk": WF_CTES["bk"].replace("JOIN tr t USING (symbol, fold)", """JOIN tt t ON t.symbol = u.symbol AND t.ts >= u.start AND t.ts < u."end" """)
       .replace("SELECT symbol,", "SELECT u.symbol,"),
     **draw_ctes()},
    f"SELECT symbol, n_null AS n_null_iters, {op.r6('p5')} AS p5, {op.r6('p50')} AS p50, {op.r6('p95')} AS p95 FROM ct", recursive=True))
def paired_block_bootstrap(spark, sf):
    base = F.expr("TIMESTAMP_NTZ '2024-01-01'")
    fold = F.floor(F.datediff("ts", base) / 10).cast("long")
    trades = boot_trades(spark, sf).withColumn("fold", fold)
    ten_days = F.make_dt_interval(F.lit(10))
    windows = trades.groupBy(*KEYS).agg(F.max("fold").alias("_last")).select(*KEYS, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("fold"))
    windows = windows.select(
        *KEYS, "fold", (base + ten_days * F.col("fold")).alias("start"), (base + ten_days * (F.col("fold") + 1)).alias("end"), (F.col("fold") * 8).alias("block0")
    )
    blocks = boot.block_sums(trades, windows, KEYS)
    out = boot.delta_percentiles(boot.paired_block_bootstrap(blocks, KEYS), KEYS)
    return rounded(out, ("p5", "p50", "p95"), "symbol", "n_null_iters")


@query("iid_bootstrap", with_sql(
    {**_BOOT_CTES,
     "ix": "SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY pos) - 1 AS idx, count(*) OVER (PARTITION BY symbol, side) AS n FROM tt",
     "dw": """SELECT symbol, side, iteration, CAST('0x' || substr(md5('42|' || side || '|' || iteration || '|' || idx), 1, 8) AS BIGINT) % n AS idx
       FROM ix, range(1000) g(iteration)""",
     "sm": """SELECT d.symbol, d.iteration, coalesce(sum(ret) FILTER (d.side = 'model' AND ret > 0), 0) AS mg, coalesce(sum(-ret) FILTER (d.side = 'model' AND ret < 0), 0) AS ml,
       coalesce(sum(ret) FILTER (d.side = 'naive' AND ret > 0), 0) AS ng, coalesce(sum(-ret) FILTER (d.side = 'naive' AND ret < 0), 0) AS nl,
       count(*) FILTER (d.side = 'model') AS mn, count(*) FILTER (d.side = 'naive') AS nn
       FROM dw d JOIN ix ON ix.symbol = d.symbol AND ix.side = d.side AND ix.idx = d.idx GROUP BY ALL""",
     "dl": f"SELECT symbol, iteration, {op.pf('mg', 'ml', 'mn')} - {op.pf('ng', 'nl', 'nn')} AS delta FROM sm",
     "ct": WF_CTES["ct"]},
    f"SELECT symbol, n_null AS n_null_iters, {op.r6('p5')} AS p5, {op.r6('p50')} AS p50, {op.r6('p95')} AS p95 FROM ct", recursive=True))
def iid_bootstrap(spark, sf):
    trades = boot_trades(spark, sf)
    indexed = with_position(trades, [*KEYS, "side"], "ts", name="idx").select(*KEYS, "side", "idx", "ret")
    out = boot.delta_percentiles(boot.iid_bootstrap(indexed, KEYS, n_iter=1000), KEYS)
    return rounded(out, ("p5", "p50", "p95"), "symbol", "n_null_iters")
