"""Queries on bars, keys, indicators and as-of enrichments."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from barloom.functions.keys import canonical_symbol, r6, timeframe_hours
from barloom.operators.asof import asof_join, keep_last
from barloom.operators.indicators import technicals
from barloom.plans import enrich
from barloom.registry import fixtures as fx
from barloom.registry import oracle_parts as op
from barloom.registry.core import query
from barloom.registry.oracle_parts import with_sql

BAR_COLS = ("open", "high", "low", "close", "volume", "n_trades")


def rounded(df, doubles, *others):
    return df.select(*others, *[r6(F.col(c)).alias(c) for c in doubles])


def rounded_sql(doubles, *others):
    return ", ".join([*others, *[f"{op.r6(c)} AS {c}" for c in doubles]])


def _bars_sql(tf):
    cols = rounded_sql(("open", "high", "low", "close", "volume"), "symbol", "timeframe", "ts", "n_trades")
    return with_sql({f"bars_{tf}": None}, f"SELECT {cols} FROM bars_{tf}")


@query("bars_4h", _bars_sql("4h"))
def bars_4h(spark, sf):
    return rounded(fx.bars(spark, sf, "4h"), ("open", "high", "low", "close", "volume"), "symbol", "timeframe", "ts", "n_trades")


@query("bars_1d", _bars_sql("1d"))
def bars_1d(spark, sf):
    return rounded(fx.bars(spark, sf, "1d"), ("open", "high", "low", "close", "volume"), "symbol", "timeframe", "ts", "n_trades")


@query(
    "dedupe_keep_last",
    """SELECT user_id, event_type, ts, round(value, 6) AS value, event_id FROM
    (SELECT user_id, event_type, date_trunc('hour', ts) AS ts, value, event_id FROM events)
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY event_id DESC) = 1""",
)
def dedupe_keep_last(spark, sf):
    rows = fx.table(spark, sf, "events").select(
        "user_id", "event_type", fx.floor_hours("ts", 1).alias("ts"), F.round("value", 6).alias("value"), "event_id"
    )
    return keep_last(rows, ["user_id", "event_type", "ts"], "event_id")


_RAW_SYMBOL = "CASE event_id % 3 WHEN 0 THEN upper(event_type) || '/USDT' WHEN 1 THEN upper(event_type) || '/USDT:USDT' ELSE upper(event_type) || '_USDT' END"


@query(
    "symbol_canonical",
    f"""SELECT raw, split_part(regexp_replace(raw, '[/:]', '_', 'g'), '_USDT', 1) || '_USDT' AS symbol, count(*) AS n
    FROM (SELECT {_RAW_SYMBOL} AS raw FROM events) GROUP BY 1, 2""",
)
def symbol_canonical(spark, sf):
    raw = fx.table(spark, sf, "events").select(F.expr(_RAW_SYMBOL).alias("raw"))
    return raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select("raw", canonical_symbol(F.col("raw")).alias("symbol"), "n")


_TF_TEXT = "CAST(event_id % 12 + 1 AS STRING) || substr('smhdwM', CAST(event_id % 6 + 1 AS INT), 1)"


@query(
    "timeframe_hours",
    f"""SELECT timeframe, round(CAST(regexp_extract(timeframe, '^(\\d+)', 1) AS DOUBLE) *
    CASE right(timeframe, 1) WHEN 's' THEN 1.0::DOUBLE / 3600 WHEN 'm' THEN 1.0::DOUBLE / 60 WHEN 'h' THEN 1 WHEN 'd' THEN 24
    WHEN 'w' THEN 168 ELSE 720 END, 6) AS hours, count(*) AS n
    FROM (SELECT {_TF_TEXT.replace('STRING', 'VARCHAR')} AS timeframe FROM events) GROUP BY 1, 2""",
)
def timeframe_hours_q(spark, sf):
    texts = fx.table(spark, sf, "events").select(F.expr(_TF_TEXT).alias("timeframe"))
    counts = texts.groupBy("timeframe").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("timeframe", F.round(timeframe_hours(F.col("timeframe")), 6).alias("hours"), "n")


def _indicator(name, tf, columns):
    sql = with_sql(op.features(tf), f"SELECT {rounded_sql(columns, 'symbol', 'ts')} FROM feat", recursive=True)

    @query(name, sql)
    def run(spark, sf, tf=tf, columns=columns):
        return rounded(technicals(fx.bars(spark, sf, tf), columns), columns, "symbol", "ts")


_indicator("sma_rel_volume", "1h", ("vol_sma_20", "rel_volume"))
_indicator("bollinger", "1h", ("bb_width", "bb_pos"))
_indicator("stochastic", "1h", ("stoch_k",))
_indicator("obv", "4h", ("obv",))
_indicator("ema_dist", "4h", ("ema_50", "dist_ema_50"))
_indicator("macd", "4h", ("macd", "macd_hist"))
_indicator("rsi", "4h", ("rsi_14",))
_indicator("atr", "4h", ("atr_14",))
_indicator("adx", "4h", ("adx_14",))
_ALL = (
    "rsi_14", "macd", "macd_hist", "stoch_k", "ema_50", "dist_ema_50", "adx_14", "atr_14",
    "bb_width", "bb_pos", "obv", "vol_sma_20", "rel_volume",
)
_indicator("all_technicals", "4h", _ALL)


@query(
    "sentiment_stats",
    with_sql(op.SENTIMENT, f"SELECT {rounded_sql(('fng_value', 'fng_sma_14', 'fng_vol_14'), 'ts')} FROM fng"),
)
def sentiment_stats(spark, sf):
    return rounded(enrich.sentiment_stats(fx.fng_daily(spark, sf)), ("fng_value", "fng_sma_14", "fng_vol_14"), "ts")


def _asof_sql(table, column, shift, by=True, out=None, tf="4h", pre=None):
    key = "b.symbol = r.symbol AND " if by else ""
    sym = "symbol, " if by else ""
    return with_sql(
        {f"bars_{tf}": None, **(pre or {table: None}),
         "r": f"SELECT {sym}ts + INTERVAL {shift} DAYS AS at, {column} FROM {table}"},
        f"SELECT b.symbol, b.ts, {op.r6('r.' + column)} AS {out or column} FROM bars_{tf} b ASOF LEFT JOIN r ON {key}b.ts >= r.at",
    )


@query("asof_funding", _asof_sql("f", "rate", 0, out="funding_rate_current",
                                 pre={"funding_8h": None, "f": "SELECT symbol, ts, funding_rate * 1e6 AS rate FROM funding_8h"}))
def asof_funding(spark, sf):
    funding = fx.funding_8h(spark, sf).withColumn("funding_rate", F.col("funding_rate") * 1e6)
    return rounded(enrich.add_funding_rate(fx.bars(spark, sf, "4h"), funding), ("funding_rate_current",), "symbol", "ts")


@query("asof_sentiment", with_sql(
    {"bars_4h": None, **op.with_sentiment("bars_4h")},
    f"SELECT {rounded_sql(('fng_value', 'fng_sma_14', 'fng_vol_14'), 'symbol', 'ts')} FROM fs"))
def asof_sentiment(spark, sf):
    out = enrich.add_sentiment(fx.bars(spark, sf, "4h"), fx.fng_daily(spark, sf))
    return rounded(out, ("fng_value", "fng_sma_14", "fng_vol_14"), "symbol", "ts")


@query("asof_onchain_2d", _asof_sql("onchain_daily", "onchain_active_addresses", 2, by=False))
def asof_onchain_2d(spark, sf):
    out = enrich.add_onchain_active_addresses(fx.bars(spark, sf, "4h"), fx.onchain_daily(spark, sf))
    return rounded(out, ("onchain_active_addresses",), "symbol", "ts")


@query("asof_mempool_1d", _asof_sql("mempool_daily", "mempool_fee_rate_p50", 1, by=False))
def asof_mempool_1d(spark, sf):
    out = enrich.add_mempool_fee_rate(fx.bars(spark, sf, "4h"), fx.mempool_daily(spark, sf))
    return rounded(out, ("mempool_fee_rate_p50",), "symbol", "ts")


# The sub-daily side of the daily trend: the orders' days, probed at two instants.
_PROBES = """SELECT DISTINCT o_orderstatus AS symbol, o_orderdate + INTERVAL {h} HOURS AS ts FROM orders"""


@query("asof_trend_htf", with_sql(
    {**op.numbered("1d"), **op.ema("r_e", "b", "close", 200),
     "t": """SELECT b.symbol, b.ts + INTERVAL 1 DAYS AS at, (b.close - r_e.y) / r_e.y AS trend_htf
      FROM b LEFT JOIN r_e ON r_e.symbol = b.symbol AND r_e.rn = b.rn""",
     "p": f"{_PROBES.format(h=0)} UNION ALL {_PROBES.format(h=20)}"},
    f"SELECT p.symbol, p.ts, {op.r6('t.trend_htf')} AS trend_htf FROM p ASOF LEFT JOIN t ON p.symbol = t.symbol AND p.ts >= t.at",
    recursive=True))
def asof_trend_htf(spark, sf):
    days = fx.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("symbol"), F.col("o_orderdate").alias("day")).distinct()
    probes = days.select(
        "symbol", F.explode(F.array(F.col("day"), F.col("day") + F.expr("INTERVAL 20 HOURS"))).alias("ts")
    )
    return rounded(enrich.add_trend_htf(probes, fx.daily_bars(spark, sf)), ("trend_htf",), "symbol", "ts")


@query("asof_generic", with_sql(
    {"bars_1h": None, "bars_4h": None},
    f"""SELECT l.symbol, l.ts, {op.r6('r.close')} AS close_4h, r.n_trades::DOUBLE AS n_4h FROM bars_1h l
    ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL 4 HOURS AS at, close, n_trades FROM bars_4h) r
    ON l.symbol = r.symbol AND l.ts >= r.at"""))
def asof_generic(spark, sf):
    right = fx.bars(spark, sf, "4h").select("symbol", "ts", F.col("close").alias("close_4h"), F.col("n_trades").cast("double").alias("n_4h"))
    left = fx.bars(spark, sf, "1h").select("symbol", "ts")
    out = asof_join(left, right, ["close_4h", "n_4h"], timedelta(hours=4), ["symbol"])
    return rounded(out, ("close_4h",), "symbol", "ts", "n_4h")


@query("taker_buy_ratio", with_sql(
    {"bars_1h": None},
    f"SELECT symbol, ts, {op.r6('CASE WHEN volume > 0 THEN taker_buy_base_vol / volume END')} AS taker_buy_ratio FROM bars_1h"))
def taker_buy_ratio(spark, sf):
    return rounded(enrich.add_taker_buy_ratio(fx.bars(spark, sf, "1h")), ("taker_buy_ratio",), "symbol", "ts")
