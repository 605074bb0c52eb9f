"""Landed API payloads to typed tables.

Every function takes a table of raw pages (``payload`` JSON text, ``ingest_seq`` the
order of arrival) plus the keys the page was fetched for. Malformed numbers become
NULL; of several copies of a key the last one ingested wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.asof import keep_last

# Positions in a kline array.
KLINE_FIELDS = (
    "open_time", "open", "high", "low", "close", "volume", "close_time",
    "quote_volume", "n_trades", "taker_buy_base_vol", "taker_buy_quote_vol", "ignore",
)
KLINE_NUMBERS = ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base_vol", "taker_buy_quote_vol")


def _naive(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


def _millis(value: Column) -> Column:
    return _naive(F.timestamp_millis(value.try_cast("bigint")))


def _day_of_seconds(value: Column) -> Column:
    return _naive(F.date_trunc("day", F.timestamp_seconds(value.try_cast("bigint"))))


def _number(value: Column) -> Column:
    """Numeric text or NULL; "NaN" counts as missing."""
    parsed = value.try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def _exploded(pages: DataFrame, schema: str, items: str, keys: Sequence[str]) -> DataFrame:
    """One row per item; the order inside a page breaks ties of ``ingest_seq``."""
    parsed = pages.select(*keys, "ingest_seq", F.from_json("payload", schema).alias("_p"))
    return parsed.select(*keys, "ingest_seq", F.posexplode(F.expr(items)).alias("_i", "_item"))


def _latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    known = rows.filter(F.col("ts").isNotNull()).withColumn("_seq", F.struct("ingest_seq", "_i"))
    return keep_last(known, [*keys, "ts"], "_seq").drop("_seq", "ingest_seq", "_i")


def ohlcv_bars(pages: DataFrame) -> DataFrame:
    """Pages ``[[ms, o, h, l, c, v], ...]`` to bars. Keys: symbol, timeframe."""
    keys = ("symbol", "timeframe")
    rows = _exploded(pages, "array<array<string>>", "_p", keys)
    values = [_number(F.col("_item")[i]).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)]
    return _latest(rows.select(*keys, "ingest_seq", "_i", _millis(F.col("_item")[0]).alias("ts"), *values), keys)


def kline_bars(pages: DataFrame) -> DataFrame:
    """Pages of twelve-field klines to bars with microstructure columns."""
    keys = ("symbol", "timeframe")
    rows = _exploded(pages, "array<array<string>>", "_p", keys)
    field = {name: F.col("_item")[i] for i, name in enumerate(KLINE_FIELDS)}
    return _latest(
        rows.select(
            *keys,
            "ingest_seq",
            "_i",
            _millis(field["open_time"]).alias("ts"),
            *[_number(field[name]).alias(name) for name in KLINE_NUMBERS],
            field["n_trades"].try_cast("bigint").alias("n_trades"),
        ),
        keys,
    )


def funding_rates(pages: DataFrame) -> DataFrame:
    """Pages ``[{timestamp, fundingRate}, ...]`` to settled rates. Key: symbol."""
    rows = _exploded(pages, "array<struct<timestamp:string,fundingRate:string>>", "_p", ("symbol",))
    return _latest(
        rows.select(
            "symbol", "ingest_seq", "_i", _millis(F.col("_item.timestamp")).alias("ts"),
            _number(F.col("_item.fundingRate")).alias("funding_rate"),
        ),
        ("symbol",),
    )


def fear_and_greed(pages: DataFrame) -> DataFrame:
    """``{"data": [{"value", "timestamp"}]}``, seconds as text, to daily values."""
    rows = _exploded(pages, "struct<data:array<struct<value:string,timestamp:string>>>", "_p.data", ())
    return _latest(
        rows.select(
            "ingest_seq", "_i", _day_of_seconds(F.col("_item.timestamp")).alias("ts"),
            _number(F.col("_item.value")).alias("fng_value"),
        ),
        (),
    )


def onchain_active_addresses(pages: DataFrame) -> DataFrame:
    """``{"values": [{"x": seconds, "y": count}]}`` to daily counts."""
    rows = _exploded(pages, "struct<values:array<struct<x:string,y:string>>>", "_p.values", ())
    return _latest(
        rows.select(
            "ingest_seq", "_i", _day_of_seconds(F.col("_item.x")).alias("ts"),
            _number(F.col("_item.y")).alias("onchain_active_addresses"),
        ),
        (),
    )


def mempool_fee_rates(pages: DataFrame) -> DataFrame:
    """``[{timestamp: instant inside the day, avgFee_50}]`` to daily medians."""
    rows = _exploded(pages, "array<struct<timestamp:string,avgFee_50:string>>", "_p", ())
    return _latest(
        rows.select(
            "ingest_seq", "_i", _day_of_seconds(F.col("_item.timestamp")).alias("ts"),
            _number(F.col("_item.avgFee_50")).alias("mempool_fee_rate_p50"),
        ),
        (),
    )
