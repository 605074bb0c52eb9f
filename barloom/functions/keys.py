"""Key columns: symbols, timeframes and the instants derived from them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hours per timeframe unit; a month counts as 720 hours.
UNIT_HOURS = {"s": 1 / 3600, "m": 1 / 60, "h": 1.0, "d": 24.0, "w": 168.0, "M": 720.0}
TIMEFRAME_PATTERN = r"^(\d+)([smhdwM])$"


def canonical_symbol(symbol: Column) -> Column:
    """``BTC/USDT:USDT`` -> ``BTC_USDT``: separators become ``_``, one quote suffix."""
    base = F.split(F.regexp_replace(symbol, "[/:]", "_"), "_USDT").getItem(0)
    return F.concat(base, F.lit("_USDT"))


def timeframe_hours(timeframe: Column) -> Column:
    """Length of a timeframe string in hours; an unknown string fails the job."""
    count = F.regexp_extract(timeframe, TIMEFRAME_PATTERN, 1)
    unit = F.regexp_extract(timeframe, TIMEFRAME_PATTERN, 2)
    hours = F.lit(None).cast("double")
    for name, value in UNIT_HOURS.items():
        hours = F.when(unit == name, F.lit(float(value))).otherwise(hours)
    return F.when(
        unit == "", F.raise_error(F.concat(F.lit("unsupported timeframe: "), timeframe)).cast("double")
    ).otherwise(count.try_cast("double") * hours)


def parse_timeframe(timeframe: str) -> float:
    """The same rule for one literal, used for plan parameters."""
    match = re.match(TIMEFRAME_PATTERN, timeframe)
    if match is None:
        raise ValueError(f"unsupported timeframe: {timeframe!r}")
    return int(match.group(1)) * UNIT_HOURS[match.group(2)]


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a naive UTC timestamp (session time zone: UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def bar_open(ts: Column, timeframe: Column) -> Column:
    """Daily and coarser bars open at midnight; finer bars keep their instant."""
    midnight = F.date_trunc("day", ts).cast("timestamp_ntz")
    return F.when(timeframe_hours(timeframe) >= 24.0, midnight).otherwise(ts)


def r6(value: Column) -> Column:
    """Six decimals without a negative zero: stable across engines and plans."""
    rounded = F.round(value, 6)
    return F.when(rounded == 0.0, F.lit(0.0)).otherwise(rounded)
