"""Enrichments: external series and derived features joined to bars.

Each function takes bars and returns them with new columns. The availability lag of
every external series is fixed here, in one place.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.asof import asof_daily, asof_join
from barloom.operators.indicators import ema, technicals

# When a row of an external series may be used, after its key.
LAG = {
    "sentiment": timedelta(0),
    "funding_rate": timedelta(0),
    "trend_htf": timedelta(days=1),
    "mempool_fee_rate_p50": timedelta(days=1),
    "onchain_active_addresses": timedelta(days=2),
}


def sentiment_stats(daily: DataFrame) -> DataFrame:
    """14-day mean and deviation of the global index (a few thousand rows, one series)."""
    order = Window.partitionBy(F.lit("global")).orderBy("ts").rowsBetween(-13, 0)
    whole = F.count("fng_value").over(order) == 14
    return daily.select(
        "ts",
        "fng_value",
        F.when(whole, F.avg("fng_value").over(order)).alias("fng_sma_14"),
        F.when(whole, F.stddev_samp("fng_value").over(order)).alias("fng_vol_14"),
    )


def add_sentiment(bars: DataFrame, daily: DataFrame) -> DataFrame:
    return asof_daily(bars, sentiment_stats(daily), ["fng_value", "fng_sma_14", "fng_vol_14"], LAG["sentiment"])


def add_onchain_active_addresses(bars: DataFrame, daily: DataFrame) -> DataFrame:
    return asof_daily(bars, daily, ["onchain_active_addresses"], LAG["onchain_active_addresses"])


def add_mempool_fee_rate(bars: DataFrame, daily: DataFrame) -> DataFrame:
    return asof_daily(bars, daily, ["mempool_fee_rate_p50"], LAG["mempool_fee_rate_p50"])


def add_funding_rate(bars: DataFrame, funding: DataFrame) -> DataFrame:
    """Latest settled funding rate; the key of a rate is its settlement instant."""
    right = funding.withColumnRenamed("funding_rate", "funding_rate_current")
    return asof_join(bars, right, ["funding_rate_current"], LAG["funding_rate"], by=["symbol"])


def daily_trend(daily_bars: DataFrame, length: int = 200) -> DataFrame:
    """Relative distance of the daily close from its EMA, per daily bar."""
    averaged = ema(daily_bars, "close", length, "_ema")
    trend = F.try_divide(F.col("close") - F.col("_ema"), F.when(F.col("_ema") != 0, F.col("_ema")))
    return averaged.select("symbol", "ts", trend.alias("trend_htf"))


def add_trend_htf(bars: DataFrame, daily_bars: DataFrame, length: int = 200) -> DataFrame:
    """Daily trend as known at each bar: a daily bar counts from its close on."""
    return asof_daily(bars, daily_trend(daily_bars, length), ["trend_htf"], LAG["trend_htf"], by=["symbol"])


def add_taker_buy_ratio(bars: DataFrame) -> DataFrame:
    """Share of taker buys; a table without any finite value is an error when it is read."""
    ratio = F.try_divide("taker_buy_base_vol", F.when(F.col("volume") > 0, F.col("volume")))
    finite = bars.agg(F.count(ratio)).scalar()
    failed = F.raise_error(F.lit("no finite taker_buy_ratio: the bars carry no taker volume")).cast("double")
    return bars.withColumn("taker_buy_ratio", F.when(finite > 0, ratio).otherwise(failed))


def add_technicals(bars: DataFrame) -> DataFrame:
    return technicals(bars)
