"""Bars and external series derived from the given tables.

A test adapter: it stands in for downloaded candles (FIXTURES.md, part B).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.keys import epoch_micros
from barloom.operators.quantiles import exact_quantiles

HOUR = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def floor_hours(ts: str, hours: int):
    micros = epoch_micros(F.col(ts))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(hours * HOUR))).cast("timestamp_ntz")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("symbol"),
        "ts",
        (F.lit(100.0) + F.col("value")).alias("price"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("qty"),
        (F.col("user_id") % 2 == 0).alias("taker"),
    )


def _ohlc(order: list[str]) -> list:
    by = F.struct(*order)
    return [
        F.min_by("price", by).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", by).alias("close"),
        F.sum("qty").cast("double").alias("volume"),
    ]


def intraday_bars(spark: SparkSession, sf_dir: str, timeframe: str) -> DataFrame:
    hours = int(timeframe.removesuffix("h"))
    return (
        ticks(spark, sf_dir)
        .groupBy("symbol", F.lit(timeframe).alias("timeframe"), floor_hours("ts", hours).alias("bar_ts"))
        .agg(
            *_ohlc(["ts", "event_id"]),
            F.count(F.lit(1)).alias("n_trades"),
            F.sum(F.when(F.col("taker"), F.col("qty")).otherwise(0)).cast("double").alias("taker_buy_base_vol"),
            F.sum(F.col("price") * F.col("qty")).alias("quote_volume"),
        )
        .withColumnRenamed("bar_ts", "ts")
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_from(table(spark, sf_dir, "orders"))


def daily_from(rows: DataFrame) -> DataFrame:
    orders = rows.select(
        F.col("o_orderstatus").alias("symbol"),
        F.col("o_orderdate").alias("ts"),
        "o_orderkey",
        (F.lit(1000.0) + F.col("o_totalprice") / 1000.0).alias("price"),
        (F.col("o_orderkey") % 97 + 1).alias("qty"),
    )
    return orders.groupBy("symbol", F.lit("1d").alias("timeframe"), "ts").agg(
        *_ohlc(["o_orderkey"]), F.count(F.lit(1)).alias("n_trades")
    )


def bars(spark: SparkSession, sf_dir: str, timeframe: str) -> DataFrame:
    return daily_bars(spark, sf_dir) if timeframe == "1d" else intraday_bars(spark, sf_dir, timeframe)


def _day(ts: str = "ts"):
    return floor_hours(ts, 24).alias("ts")


def fng_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bought = F.count_if(F.col("event_type") == "purchase")
    return events.groupBy(_day()).agg(
        F.floor(F.lit(100.0) * bought / F.count(F.lit(1))).cast("double").alias("fng_value")
    )


def funding_8h(spark: SparkSession, sf_dir: str) -> DataFrame:
    settled = floor_hours("ts", 8) + F.expr("INTERVAL 8 HOURS")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("symbol"), settled.alias("settled"))
        .agg((F.avg("value") / 1e5).alias("funding_rate"))
        .withColumnRenamed("settled", "ts")
    )


def onchain_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(_day()).agg(
        F.countDistinct("user_id").cast("double").alias("onchain_active_addresses")
    )


def mempool_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "events").select(_day(), "value")
    return exact_quantiles(values, ["ts"], "value", {"mempool_fee_rate_p50": 0.5})


def md5_score(*parts):
    """Deterministic stand-in for a model: a uniform value in [0, 1)."""
    digest = F.md5(F.concat_ws(":", *[part.cast("string") for part in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10000 / 10000.0


# --- the same fixtures as DuckDB common table expressions ---------------------

SQL = {
    "ticks": """
  SELECT event_id, event_type AS symbol, ts, 100.0::DOUBLE + value AS price,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) + 1 AS qty, user_id % 2 = 0 AS taker
  FROM events""",
    "fng_daily": """
  SELECT date_trunc('day', ts) AS ts,
         floor(100.0::DOUBLE * count(*) FILTER (event_type = 'purchase') / count(*)) AS fng_value
  FROM events GROUP BY 1""",
    "funding_8h": """
  SELECT event_type AS symbol, time_bucket(INTERVAL 8 HOURS, ts) + INTERVAL 8 HOURS AS ts,
         avg(value) / 1e5::DOUBLE AS funding_rate
  FROM events GROUP BY 1, 2""",
    "onchain_daily": """
  SELECT date_trunc('day', ts) AS ts, count(DISTINCT user_id)::DOUBLE AS onchain_active_addresses
  FROM events GROUP BY 1""",
    "mempool_daily": """
  SELECT date_trunc('day', ts) AS ts, quantile_cont(value, 0.5) AS mempool_fee_rate_p50
  FROM events GROUP BY 1""",
    "bars_1d": """
  SELECT o_orderstatus AS symbol, '1d' AS timeframe, o_orderdate AS ts,
         arg_min(1000.0::DOUBLE + o_totalprice / 1000.0, o_orderkey) AS open,
         max(1000.0::DOUBLE + o_totalprice / 1000.0) AS high, min(1000.0::DOUBLE + o_totalprice / 1000.0) AS low,
         arg_max(1000.0::DOUBLE + o_totalprice / 1000.0, o_orderkey) AS close,
         sum(o_orderkey % 97 + 1)::DOUBLE AS volume, count(*) AS n_trades
  FROM orders GROUP BY 1, 2, 3""",
}
for _hours in (1, 4):
    SQL[f"bars_{_hours}h"] = f"""
  SELECT symbol, '{_hours}h' AS timeframe, time_bucket(INTERVAL {_hours} HOURS, ts) AS ts,
         first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ts, event_id) AS close, sum(qty)::DOUBLE AS volume, count(*) AS n_trades,
         coalesce(sum(qty) FILTER (taker), 0)::DOUBLE AS taker_buy_base_vol, sum(price * qty) AS quote_volume
  FROM ticks GROUP BY ALL"""


def with_sql(ctes: dict[str, str], query: str, recursive: bool = False) -> str:
    """Assemble ``WITH`` from named fixtures (value None) and given expressions."""
    parts: dict[str, str] = {}
    for name, body in ctes.items():
        if body is None:
            body = SQL[name]
            if name in ("bars_1h", "bars_4h"):
                parts["ticks"] = SQL["ticks"]
        parts[name] = body
    text = ",\n".join(f"{name} AS MATERIALIZED ({body})" if not name.startswith("r_") else f"{name} AS ({body})"
                      for name, body in parts.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{text}\n{query}"
