"""Explicit schemas: no reader in this package infers types from data."""

from __future__ import annotations

from pyspark.sql import types as T

SERIES_KEYS = ("symbol", "timeframe")


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_PRICE = tuple((name, T.DoubleType()) for name in ("open", "high", "low", "close", "volume"))

BAR_FILE = _schema(("timestamp", T.TimestampNTZType()), *_PRICE)

BAR = _schema(
    ("symbol", T.StringType()),
    ("timeframe", T.StringType()),
    ("ts", T.TimestampNTZType()),
    *_PRICE,
)

MICRO_BAR = T.StructType(
    BAR.fields
    + _schema(
        ("quote_volume", T.DoubleType()),
        ("n_trades", T.LongType()),
        ("taker_buy_base_vol", T.DoubleType()),
        ("taker_buy_quote_vol", T.DoubleType()),
    ).fields
)

FUNDING = _schema(
    ("symbol", T.StringType()), ("ts", T.TimestampNTZType()), ("funding_rate", T.DoubleType())
)
SENTIMENT = _schema(("ts", T.TimestampNTZType()), ("fng_value", T.DoubleType()))
ONCHAIN = _schema(("ts", T.TimestampNTZType()), ("onchain_active_addresses", T.DoubleType()))
MEMPOOL = _schema(("ts", T.TimestampNTZType()), ("mempool_fee_rate_p50", T.DoubleType()))

# Label columns are never features; price columns leave before training.
LABEL_COLS = ("target", "target_ret", "label_complete")
SENTIMENT_COLS = ("fng_value", "fng_sma_14", "fng_vol_14")
