"""Queries on normalisers, series helpers, sizing, scans and small reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.keys import epoch_micros, r6
from barloom.operators import sizing
from barloom.operators.columns import clean
from barloom.operators.indicators import technicals
from barloom.operators.labels import barrier_labels, extrema_labels
from barloom.operators.layout import drop_halo, with_halo, with_position
from barloom.operators.scan import forward_fill
from barloom.operators.splits import min_val_trades, split_sizes
from barloom.plans import diagnostics as diag
from barloom.plans import jobs, sweep
from barloom.plans.dataset import Sources, build_dataset
from barloom.registry import fixtures as fx
from barloom.registry import oracle_parts as op
from barloom.registry.core import query
from barloom.registry.features_q import rounded, rounded_sql
from barloom.registry.labels_q import atr_bars
from barloom.registry.oracle_parts import dbl, with_sql
from barloom.registry.trades_q import KEYS, SWING, evaluated, evaluated_sql
from barloom.sources import normalise, tables

# --- S2-S7: payloads rendered from the bars and parsed back ----------------------


def _pages(rows, keys, item, wrap="[{}]"):
    """Two landings per day: all rows, then corrected copies of the 08:00 rows."""
    left, right = wrap.split("{}")
    day = rows.withColumn("_day", F.to_date("ts"))

    def page(part, seq):
        text = F.concat(F.lit(left), F.concat_ws(",", F.sort_array(F.collect_list("_item"))), F.lit(right))
        return part.groupBy(*keys, "_day").agg(text.alias("payload")).select(*keys, "payload", F.lit(seq).cast("long").alias("ingest_seq"))

    first = page(day.withColumn("_item", item(F.lit(0.0))), 1)
    second = page(day.filter(F.hour("ts") == 8).withColumn("_item", item(F.lit(1.0))), 2)
    return first.unionByName(second)


def _text(c):
    return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))


def _ms():
    return (epoch_micros(F.col("ts")) / 1000).cast("long").cast("string")


def _open_text():
    return F.when(F.hour("ts") == 12, F.lit('"n/a"')).otherwise(_text(F.col("open")))


_BAR_FIX = """CASE WHEN hour(ts) = 12 THEN NULL ELSE open END AS open, high, low, close,
  volume + CASE WHEN hour(ts) = 8 THEN 1 ELSE 0 END AS volume"""
_OHLCV = ("open", "high", "low", "close", "volume")


@query("normalise_ohlcv", with_sql({"bars_4h": None, "x": f"SELECT symbol, timeframe, ts, {_BAR_FIX} FROM bars_4h"},
    f"SELECT {rounded_sql(_OHLCV, 'symbol', 'timeframe', 'ts')} FROM x"))
def normalise_ohlcv(spark, sf):
    def item(bump):
        parts = [_ms(), _open_text(), *[_text(F.col(c)) for c in ("high", "low", "close")], (F.col("volume") + bump).cast("string")]
        return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))

    pages = _pages(fx.bars(spark, sf, "4h"), KEYS, item)
    return rounded(normalise.ohlcv_bars(pages), _OHLCV, "symbol", "timeframe", "ts")


_KLINE = (*_OHLCV, "quote_volume", "taker_buy_base_vol", "taker_buy_quote_vol")


@query("normalise_klines", with_sql(
    {"bars_4h": None, "x": f"""SELECT symbol, timeframe, ts, {_BAR_FIX}, quote_volume, n_trades, taker_buy_base_vol,
     NULL::DOUBLE AS taker_buy_quote_vol FROM bars_4h"""},
    f"SELECT {rounded_sql(_KLINE, 'symbol', 'timeframe', 'ts', 'n_trades')} FROM x"))
def normalise_klines(spark, sf):
    def item(bump):
        parts = [
            _ms(), _open_text(), *[_text(F.col(c)) for c in ("high", "low", "close")], _text(F.col("volume") + bump),
            (epoch_micros(F.col("ts")) / 1000 + 14_399_999).cast("long").cast("string"), _text(F.col("quote_volume")),
            F.col("n_trades").cast("string"), _text(F.col("taker_buy_base_vol")), F.lit('"NaN"'), F.lit('"0"'),
        ]
        return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))

    pages = _pages(fx.bars(spark, sf, "4h"), KEYS, item)
    return rounded(normalise.kline_bars(pages), _KLINE, "symbol", "timeframe", "ts", "n_trades")


@query("normalise_funding", with_sql({"funding_8h": None},
    f"SELECT symbol, ts, {op.r6('funding_rate * 1e6 + CASE WHEN hour(ts) = 8 THEN 1 ELSE 0 END')} AS funding_rate_micro FROM funding_8h"))
def normalise_funding(spark, sf):
    def item(bump):
        rate = F.col("funding_rate") + bump / 1e6
        return F.concat(F.lit('{"symbol":"x","timestamp":'), _ms(), F.lit(',"fundingRate":'), rate.cast("string"), F.lit("}"))

    out = normalise.funding_rates(_pages(fx.funding_8h(spark, sf), ["symbol"], item))
    return out.select("symbol", "ts", r6(F.col("funding_rate") * 1e6).alias("funding_rate_micro"))


def _seconds(offset=0):
    return ((epoch_micros(F.col("ts")) / 1_000_000).cast("long") + offset).cast("string")


@query("normalise_sentiment", with_sql({"fng_daily": None}, f"SELECT ts, {op.r6('fng_value')} AS fng_value FROM fng_daily"))
def normalise_sentiment(spark, sf):
    def item(bump):
        return F.concat(F.lit('{"value":"'), (F.col("fng_value") + bump).cast("string"), F.lit('","timestamp":"'), _seconds(), F.lit('"}'))

    pages = _pages(fx.fng_daily(spark, sf), [], item, '{"data":[{}]}')
    return rounded(normalise.fear_and_greed(pages), ("fng_value",), "ts")


@query("normalise_onchain", with_sql({"onchain_daily": None},
    f"SELECT ts, {op.r6('onchain_active_addresses')} AS onchain_active_addresses FROM onchain_daily"))
def normalise_onchain(spark, sf):
    def item(bump):
        return F.concat(F.lit('{"x":'), _seconds(), F.lit(',"y":'), (F.col("onchain_active_addresses") + bump).cast("string"), F.lit("}"))

    pages = _pages(fx.onchain_daily(spark, sf), [], item, '{"name":"n","values":[{}]}')
    return rounded(normalise.onchain_active_addresses(pages), ("onchain_active_addresses",), "ts")


@query("normalise_mempool", with_sql({"mempool_daily": None},
    f"SELECT ts, {op.r6('mempool_fee_rate_p50')} AS mempool_fee_rate_p50 FROM mempool_daily"))
def normalise_mempool(spark, sf):
    def item(bump):
        noon = _seconds(12 * 3600 + 54 * 60)
        return F.concat(F.lit('{"avgHeight":1,"timestamp":'), noon, F.lit(',"avgFee_50":'), (F.col("mempool_fee_rate_p50") + bump).cast("string"), F.lit("}"))

    pages = _pages(fx.mempool_daily(spark, sf), [], item)
    return rounded(normalise.mempool_fee_rates(pages), ("mempool_fee_rate_p50",), "ts")


# --- series helpers ---------------------------------------------------------------


@query("latest_bars", with_sql({"bars_1h": None},
    f"""SELECT symbol, ts, {op.r6('close')} AS close FROM bars_1h
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100"""))
def latest_bars(spark, sf):
    return rounded(tables.latest_bars(fx.bars(spark, sf, "1h"), 100), ("close",), "symbol", "ts")


@query("forward_fill", with_sql({**op.numbered("1h")},
    f"""SELECT symbol, ts, {op.r6('last_value(CASE WHEN volume % 3 = 0 THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts)')} AS filled FROM b"""))
def forward_fill_q(spark, sf):
    gaps = fx.bars(spark, sf, "1h").withColumn("gappy", F.when(F.col("volume") % 3 == 0, F.col("close")))
    blocked = drop_halo(with_halo(with_position(gaps)))
    return rounded(forward_fill(blocked, "gappy", out="filled"), ("filled",), "symbol", "ts")


@query("regime_slice", with_sql({"bars_1d": None},
    f"""SELECT symbol, r.regime, count(*) AS n_bars, {op.r6('100 * (arg_max(close, ts) / arg_min(close, ts) - 1)')} AS cum_return_pct
    FROM bars_1d JOIN (VALUES ('closed', TIMESTAMP '1996-01-01', TIMESTAMP '1996-12-31'), ('half_open', TIMESTAMP '1997-01-01', TIMESTAMP '1997-12-30 23:59:59')) r(regime, lo, hi)
    ON ts BETWEEN r.lo AND r.hi GROUP BY ALL"""))
def regime_slice(spark, sf):
    bars = fx.bars(spark, sf, "1d")
    closed = tables.date_range(bars, "1996-01-01", "1996-12-31", closed=True).withColumn("regime", F.lit("closed"))
    half = tables.date_range(bars, "1997-01-01", "1997-12-31").withColumn("regime", F.lit("half_open"))
    both = closed.unionByName(half)
    growth = F.max_by("close", "ts") / F.min_by("close", "ts") - 1
    return both.groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n_bars"), r6(F.lit(100.0) * growth).alias("cum_return_pct"))


_DATASET = ("rsi_14", "macd", "macd_hist", "stoch_k", "dist_ema_50", "adx_14", "atr_14", "bb_width", "bb_pos", "obv",
            "rel_volume", "fng_value", "fng_sma_14", "fng_vol_14", "close", "target_ret")


@query("dataset_control", with_sql(
    {**op.features("4h"), **op.with_sentiment(), **op.labels("fs"),
     "z": f"SELECT * FROM lab WHERE {' AND '.join(c + ' IS NOT NULL' for c in _DATASET)}"},
    f"""SELECT {rounded_sql(_DATASET, 'symbol', 'ts', 'target')}, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM z""",
    recursive=True))
def dataset_control(spark, sf):
    out, _ = build_dataset(fx.bars(spark, sf, "4h"), Sources(sentiment=fx.fng_daily(spark, sf)))
    return rounded(out, _DATASET, "symbol", "ts", "target", "rn")


# Profiles with a treatment on 4h bars: source, its SQL with ``ts`` from which a row may be used, column, scale for rounding.
_TREATED = {
    "funding_rate": ({"funding_8h": None, "tt": "SELECT symbol, ts, funding_rate AS v FROM funding_8h"}, "funding_rate_current", 1e6),
    "onchain_activity": ({"onchain_daily": None, "tt": "SELECT ts + INTERVAL 2 DAYS AS ts, onchain_active_addresses AS v FROM onchain_daily"}, "onchain_active_addresses", 1.0),
    "onchain_fee_pressure": ({"mempool_daily": None, "tt": "SELECT ts + INTERVAL 1 DAYS AS ts, mempool_fee_rate_p50 AS v FROM mempool_daily"}, "mempool_fee_rate_p50", 1.0),
    "taker_buy_ratio": ({}, "taker_buy_ratio", 1.0),
}


def _profile_sql(profile):
    ctes, column, scale = _TREATED[profile]
    if ctes:
        on = "x.symbol = t.symbol AND " if profile == "funding_rate" else ""
        joined = f"SELECT x.*, t.v AS {column} FROM fs x ASOF LEFT JOIN tt t ON {on}x.ts >= t.ts"
    else:
        joined = f"SELECT *, CASE WHEN volume > 0 THEN taker_buy_base_vol / volume END AS {column} FROM fs"
    kept = (*_DATASET, column)
    return with_sql(
        {**op.features("4h"), **op.with_sentiment(), **ctes, "ft": joined, **op.labels("ft"),
         "z": f"SELECT * FROM lab WHERE {' AND '.join(c + ' IS NOT NULL' for c in kept)}"},
        f"""SELECT {rounded_sql(_DATASET, 'symbol', 'ts', 'target')}, {op.r6(f'{column} * {scale!r}::DOUBLE')} AS {column},
        row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM z""", recursive=True)


def _profile_query(profile):
    column, scale = _TREATED[profile][1:]

    def run(spark, sf):
        sources = Sources(sentiment=fx.fng_daily(spark, sf), funding=fx.funding_8h(spark, sf), onchain=fx.onchain_daily(spark, sf), mempool=fx.mempool_daily(spark, sf))
        out, features = build_dataset(fx.bars(spark, sf, "4h"), sources, profile)
        assert len(features) == 14 and column not in features
        return rounded(out.withColumn(column, F.col(column) * scale), (*_DATASET, column), "symbol", "ts", "target", "rn")

    return query(f"dataset_{profile}", _profile_sql(profile))(run)


for _profile in _TREATED:
    _profile_query(_profile)


@query("split_sizes", with_sql({**op.numbered("1d")},
    """SELECT symbol, swing, n_bars, greatest(8, floor(nv / (swing * 5) * 0.5::DOUBLE)::BIGINT) AS min_val_trades,
    CASE WHEN n_bars < 200 + 8 * swing * 5 + 10 * swing * 5 + 2 * swing THEN 'too_few_bars'
         WHEN nv + nt > alloc * 0.45::DOUBLE THEN 'held_out_share' WHEN alloc - nv - nt < 200 THEN 'train_floor' END AS split_reason
    FROM (SELECT symbol, swing, n_bars, n_bars - 2 * swing AS alloc,
      greatest(8 * swing * 5, floor((n_bars - 2 * swing) * 0.15::DOUBLE)::BIGINT) AS nv,
      greatest(10 * swing * 5, floor((n_bars - 2 * swing) * 0.15::DOUBLE)::BIGINT) AS nt
      FROM (SELECT DISTINCT symbol, n_bars FROM b), (VALUES (2), (5), (10), (20), (60)) s(swing))"""))
def split_sizes_q(spark, sf):
    sizes = fx.bars(spark, sf, "1d").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_bars"))
    grid = sweep.fan_out(sizes, F.array(*[F.lit(s) for s in (2, 5, 10, 20, 60)]), "swing")
    out = split_sizes(grid, F.col("swing"), F.col("swing"))
    # The floor of the validation block does not depend on the split being possible.
    alloc = F.col("n_bars") - 2 * F.col("swing")
    n_val = F.greatest(8 * F.col("swing") * 5, F.floor(alloc * 0.15))
    return out.select("symbol", "swing", "n_bars", min_val_trades(n_val, F.col("swing"), 5).alias("min_val_trades"), "split_reason")


# --- signals, sizing, small reports ------------------------------------------------

_NEWEST = "SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) = 1"
_MODELS_SQL = "(VALUES ('a', 0.2::DOUBLE, 1.5::DOUBLE, 1.0::DOUBLE), ('b', 0.5::DOUBLE, 2.0::DOUBLE, 1.5::DOUBLE)) m(model, threshold, tp_multi, sl_multi)"


def _models(bars):
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(t).alias("threshold"), F.lit(a).alias("tp_multi"), F.lit(b).alias("sl_multi"))
                     for m, t, a, b in (("a", 0.2, 1.5, 1.0), ("b", 0.5, 2.0, 1.5))])
    return bars.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).select(*KEYS, F.explode(rows).alias("_m")).select(*KEYS, "_m.*")


def scan(spark, sf):
    ev = evaluated(spark, sf, "4h")
    return jobs.latest_signals(ev, _models(ev))


_SCAN = {**evaluated_sql("4h"), "nw": _NEWEST,
         "sg": f"""SELECT nw.*, model, threshold, close + coalesce(nullif(atr_14, 0), high - low) * tp_multi AS tp,
          close - coalesce(nullif(atr_14, 0), high - low) * sl_multi AS sl FROM nw JOIN {_MODELS_SQL} ON score > threshold"""}


@query("signal_scan", with_sql(_SCAN, f"SELECT {rounded_sql(('score', 'close', 'tp', 'sl'), 'symbol', 'ts', 'model')} FROM sg", recursive=True))
def signal_scan(spark, sf):
    return rounded(scan(spark, sf), ("score", "close", "tp", "sl"), "symbol", "ts", "model")


@query("position_sizing", with_sql(
    {"bars_1h": None,
     "q": """SELECT symbol, ts, close, (floor(((500::DOUBLE / close)::VARCHAR)::DECIMAL(38,18) * 1000))::DOUBLE AS steps,
          (floor((close::VARCHAR)::DECIMAL(38,18) * 20))::DOUBLE AS ticks FROM bars_1h"""},
    f"""SELECT symbol, ts, {op.r6('steps / 1000')} AS quantity, {op.r6("ticks / 20")} AS tp_tick,
    CASE WHEN steps / 1000 < 2.5::DOUBLE THEN 'below_min_qty' WHEN steps / 1000 * close < 499.9::DOUBLE THEN 'below_min_notional' END AS reject_reason FROM q"""))
def position_sizing(spark, sf):
    signals = fx.bars(spark, sf, "1h").select("symbol", "ts", "close", F.col("close").alias("tp"))
    filters = signals.select("symbol").distinct().select(
        "symbol",
        *[F.lit(v).cast(sizing.DECIMAL).alias(n) for n, v in (("step", "0.001"), ("min_qty", "2.5"), ("min_notional", "499.9"), ("tick", "0.05"))],
    )
    out = sizing.position_size(signals, filters, balance=10_000.0, risk=0.01, leverage=5)
    return out.select("symbol", "ts", r6(F.col("quantity").cast("double")).alias("quantity"), r6(F.col("tp_tick").cast("double")).alias("tp_tick"), "reject_reason")


@query("training_freshness",
    """SELECT o_orderstatus AS symbol, CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE max(o_orderdate) END AS last_trained, o_custkey AS model,
    coalesce(date_diff('day', max(o_orderdate), TIMESTAMP '2001-08-01') >= 14 OR o_custkey % 50 = 0, true) AS needs_training
    FROM orders GROUP BY o_orderstatus, o_custkey""")
def training_freshness(spark, sf):
    models = fx.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("symbol"), F.col("o_custkey").alias("model")).agg(F.max("o_orderdate").alias("_t"))
    models = models.select("symbol", "model", F.when(F.col("model") % 50 != 0, F.col("_t")).alias("last_trained"))
    return sizing.needs_training(models, F.expr("TIMESTAMP_NTZ '2001-08-01'")).select("symbol", "model", "last_trained", "needs_training")


_PNL = "value - 50"


@query("live_pf_verdict",
    f"""WITH t AS (SELECT event_type AS symbol, ts, user_id, {_PNL} AS pnl FROM events),
    nw AS (SELECT symbol, max(ts) AS newest FROM t WHERE user_id % 2 = 1 GROUP BY symbol),
    wk AS (SELECT symbol, pnl, floor((epoch(newest)::BIGINT - epoch(date_trunc('second', ts))::BIGINT) / 604800) AS week FROM t JOIN nw USING (symbol) WHERE user_id % 2 = 1),
    wf AS (SELECT symbol, week, coalesce(sum(pnl) FILTER (pnl > 0), 0) / greatest(coalesce(sum(-pnl) FILTER (pnl < 0), 0), 1e-9) AS pf FROM wk WHERE week < 2 GROUP BY ALL),
    w2 AS (SELECT symbol, max(pf) FILTER (week = 0) AS w0, max(pf) FILTER (week = 1) AS w1 FROM wf GROUP BY symbol),
    bands AS (SELECT symbol, sum(pnl) FILTER (pnl > 0) / greatest(sum(-pnl) FILTER (pnl < 0), 1e-9) * 1.05::DOUBLE AS pf_p5 FROM t WHERE user_id % 2 = 0 GROUP BY symbol),
    live AS (SELECT symbol, count(*) AS trades, coalesce(sum(pnl) FILTER (pnl > 0), 0) / greatest(coalesce(sum(-pnl) FILTER (pnl < 0), 0), 1e-9) AS live_pf
      FROM t WHERE user_id % 2 = 1 GROUP BY symbol)
    SELECT symbol, trades, {op.r6('live_pf')} AS live_pf, CASE WHEN w0 < 0.85::DOUBLE AND w1 < 0.85::DOUBLE THEN 'pause' WHEN w0 < pf_p5 * 0.9::DOUBLE THEN 'monitor'
    WHEN live_pf > pf_p5 * 1.1::DOUBLE * 1.2::DOUBLE THEN 'favorable' ELSE 'within_expectation' END AS verdict FROM live JOIN bands USING (symbol) JOIN w2 USING (symbol)""")
def live_pf_verdict(spark, sf):
    t = fx.table(spark, sf, "events").select(F.col("event_type").alias("symbol"), "ts", "user_id", (F.col("value") - 50).alias("realized_pnl"))
    pnl = F.col("realized_pnl")
    gain, loss = F.sum(F.when(pnl > 0, pnl)), F.sum(F.when(pnl < 0, -pnl))
    bands = t.filter("user_id % 2 = 0").groupBy("symbol").agg((gain / F.greatest(loss, F.lit(1e-9)) * 1.05).alias("pf_p5"))
    bands = bands.withColumn("pf_p95", F.col("pf_p5") * 1.1)
    return rounded(diag.live_verdict(t.filter("user_id % 2 = 1"), bands, ["symbol"]), ("live_pf",), "symbol", "trades", "verdict")


@query("sweep_resume", with_sql(
    {"g": f"""SELECT * FROM (VALUES {', '.join(f'({s})' for s in sweep.SWINGS)}) a(swing),
       (VALUES {', '.join(f'({tp}::DOUBLE, {sl}::DOUBLE)' for tp, sl in sweep.TP_SL_PAIRS)}) p(tp, sl), (VALUES ('4h'), ('1h')) t(timeframe)""",
     "slots": f"""SELECT * FROM g WHERE tp >= sl AND (swing, tp, sl, timeframe) NOT IN
       (SELECT * FROM (VALUES {', '.join(f"({s}, {tp}::DOUBLE, {sl}::DOUBLE, '{tf}')" for s, tp, sl, tf in sweep.EXCLUDED)}) x)""",
     "sy": "SELECT event_type AS symbol, count(*) AS n FROM events GROUP BY 1"},
    """SELECT symbol, timeframe, count(*) AS n_pending FROM sy, slots WHERE (n + swing) % 3 <> 0 GROUP BY ALL"""))
def sweep_resume(spark, sf):
    symbols = fx.table(spark, sf, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    slots = F.array_sort(F.collect_list(F.struct(*sweep.SLOT_KEYS)))
    all_slots = sweep.sweep_slots(spark).agg(slots).scalar()
    configs = sweep.fan_out(symbols, all_slots, "_s").select("symbol", "n", "_s.*")
    done = configs.filter((F.col("n") + F.col("swing")) % 3 == 0)
    left = tables.pending(configs, done, ["symbol", *sweep.SLOT_KEYS])
    return left.groupBy("symbol", "timeframe").agg(F.count(F.lit(1)).alias("n_pending"))


@query("class_weights", with_sql({**op.atr("4h"), **op.labels("a"),
    "c": "SELECT symbol, target, count(*) AS n FROM lab GROUP BY ALL",
    "t": "SELECT symbol, sum(n) AS total, count(*) AS k, coalesce(sum(n) FILTER (target = 1), 0) AS pos FROM c GROUP BY symbol"},
    f"""SELECT symbol, target, n, {op.r6('total / (k * n)::DOUBLE')} AS class_weight, {op.r6('(total - pos) / greatest(pos, 1)::DOUBLE')} AS neg_per_pos
    FROM c JOIN t USING (symbol)""", recursive=True))
def class_weights(spark, sf):
    out = diag.imbalance(barrier_labels(atr_bars(spark, sf, "4h")), ["symbol"])
    return rounded(out, ("class_weight", "neg_per_pos"), "symbol", "target", "n")


@query("precision_on_test", with_sql({**evaluated_sql("4h"),
    "x": "SELECT *, score >= 0.7::DOUBLE AS signal FROM ev WHERE rn >= floor(n_bars * 0.8::DOUBLE)"},
    f"""SELECT symbol, count(*) FILTER (signal) AS signals, count(*) FILTER (signal AND target = 1) AS hits,
    {op.r6('coalesce(count(*) FILTER (signal AND target = 1)::DOUBLE / nullif(count(*) FILTER (signal), 0), 0)')} AS precision FROM x GROUP BY symbol""", recursive=True))
def precision_on_test(spark, sf):
    out = diag.precision(jobs.oos_signals(evaluated(spark, sf, "4h"), 0.7), ["symbol"])
    return rounded(out, ("precision",), "symbol", "signals", "hits")


@query("oos_signals", with_sql(evaluated_sql("4h"),
    f"SELECT symbol, ts, {op.r6('close')} AS close, score >= 0.7::DOUBLE AS signal FROM ev WHERE rn >= floor(n_bars * 0.8::DOUBLE)", recursive=True))
def oos_signals(spark, sf):
    return rounded(jobs.oos_signals(evaluated(spark, sf, "4h"), 0.7), ("close",), "symbol", "ts", "signal")


@query("recent_signals", with_sql(evaluated_sql("4h"),
    "SELECT symbol, count(*) FILTER (score >= 0.7::DOUBLE) AS recent_signals FROM ev WHERE rn >= n_bars - 60 GROUP BY symbol", recursive=True))
def recent_signals(spark, sf):
    fired = evaluated(spark, sf, "4h").withColumn("signal", F.col("score") >= 0.7)
    return jobs.recent_signal_count(fired, ["symbol"])


@query("signal_vs_trend", with_sql(
    {**op.features("1h"), "x": f"SELECT *, {op.md5_score('symbol', 'timeframe', 'rn')} >= 0.7::DOUBLE AS signal FROM feat WHERE ema_50 IS NOT NULL"},
    f"""SELECT symbol, count(*) FILTER (signal) AS n_signals, {op.r6('100 * avg((close > ema_50)::INT) FILTER (signal)')} AS signal_above_pct,
    {op.r6('100 * avg((close > ema_50)::INT)')} AS base_above_pct FROM x GROUP BY symbol""", recursive=True))
def signal_vs_trend(spark, sf):
    bars = technicals(fx.bars(spark, sf, "1h"), ["ema_50"]).filter("ema_50 IS NOT NULL")
    scored = bars.withColumn("signal", fx.md5_score(F.col("symbol"), F.col("timeframe"), F.col("rn")) >= 0.7)
    return rounded(diag.signal_vs_trend(scored, ["symbol"]), ("signal_above_pct", "base_above_pct"), "symbol", "n_signals")
