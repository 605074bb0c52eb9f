"""Order sizing of signals in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECIMAL = "decimal(38,18)"


def floor_to_step(value: Column, step: Column) -> Column:
    """Largest multiple of ``step`` not above ``value`` (quantity step, price tick).

    A double becomes its shortest decimal; 18 digits after the point leave nothing to round up.
    """
    v, s = value.cast(DECIMAL), step.cast(DECIMAL)
    return (v - v % s).cast(DECIMAL)


def position_size(signals: DataFrame, filters: DataFrame, balance: float, risk: float = 0.01, leverage: int = 5) -> DataFrame:
    """Quantity for each signal and why it cannot be traded.

    ``filters`` has one row per traded symbol: step, min_qty, min_notional, tick.
    """
    price = F.col("close")
    notional = balance * risk * leverage
    raw = F.try_divide(F.lit(notional), F.when(price > 0, price))
    sized = signals.join(filters, "symbol", "left").withColumn("quantity", floor_to_step(raw, F.col("step")))
    value = F.col("quantity").cast("double") * price
    reason = (
        F.when(F.lit(balance <= 0), "no_balance")
        .when(F.col("step").isNull(), "unknown_symbol")
        .when(price <= 0, "bad_price")
        .when(F.col("quantity") < F.col("min_qty"), "below_min_qty")
        .when((F.col("min_notional") > 0) & (value < F.col("min_notional")), "below_min_notional")
    )
    ticks = {f"{c}_tick": floor_to_step(F.col(c), F.col("tick")) for c in ("tp", "sl") if c in signals.columns}
    return sized.withColumn("reject_reason", reason).withColumns(ticks)


def barrier_prices(signals: DataFrame, tp: Column, sl: Column) -> DataFrame:
    """Take-profit and stop prices; without an ATR the bar's range stands in."""
    atr = F.coalesce(F.nullif(F.col("atr_14"), F.lit(0.0)), F.col("high") - F.col("low"))
    return signals.withColumns({"tp": F.col("close") + atr * tp, "sl": F.col("close") - atr * sl})


def needs_training(models: DataFrame, as_of: Column, cooldown_days: int = 14) -> DataFrame:
    """Days since the last training and whether the model is due (also without a date)."""
    elapsed = F.floor((F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("last_trained").cast("timestamp"))) / 86400)
    return models.withColumns(
        {"days_elapsed": elapsed, "needs_training": F.coalesce(elapsed >= cooldown_days, F.lit(True))}
    )
