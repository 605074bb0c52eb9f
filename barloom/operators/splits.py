"""Temporal splits with embargo gaps, as column arithmetic per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.layout import with_position
from barloom.schemas import SERIES_KEYS

# Calibration of the split sizes.
VAL_TRADES_FLOOR = 8
TEST_TRADES_FLOOR = 10
TRAIN_BARS_FLOOR = 200
VAL_SHARE_FLOOR = 0.15
TEST_SHARE_FLOOR = 0.15
MAX_HELD_OUT_SHARE = 0.45
BARS_PER_TRADE = {"1d": 5, "4h": 2, "1h": 2}


def bars_per_trade(timeframe: Column) -> Column:
    """Safety factor of the timeframe; an uncalibrated one uses the daily value."""
    factor = F.lit(BARS_PER_TRADE["1d"])
    for name, value in BARS_PER_TRADE.items():
        factor = F.when(timeframe == name, value).otherwise(factor)
    return factor


def _block(trades: Column | int, per_trade: Column, allocatable: Column, share: float) -> Column:
    return F.greatest(F.lit(trades) * per_trade, F.floor(allocatable * share)).cast("long")


def split_sizes(
    df: DataFrame,
    swing: Column | int,
    embargo: Column | int,
    n_bars: str = "n_bars",
    factor: Column | None = None,
    val_trades: Column | int = VAL_TRADES_FLOOR,
    test_trades: Column | int | None = TEST_TRADES_FLOOR,
    train_floor: int = TRAIN_BARS_FLOOR,
    max_share: float = MAX_HELD_OUT_SHARE,
) -> DataFrame:
    """Add ``n_train, n_val, n_test`` and ``split_reason`` (NULL sizes when not possible).

    Each held-out block takes the larger of its trade floor and its share;
    ``test_trades=None`` makes a train/validation split with one embargo gap.
    """
    swing, embargo = (x if isinstance(x, Column) else F.lit(x) for x in (swing, embargo))
    factor = bars_per_trade(F.col("timeframe")) if factor is None else factor
    n = F.col(n_bars)
    per_trade = swing * factor
    gaps = embargo * (1 if test_trades is None else 2)
    allocatable = n - gaps
    test_floor = F.lit(0) if test_trades is None else F.lit(test_trades) * per_trade
    needed = train_floor + F.lit(val_trades) * per_trade + test_floor + gaps
    val = _block(val_trades, per_trade, allocatable, VAL_SHARE_FLOOR)
    test = F.lit(0).cast("long") if test_trades is None else _block(test_trades, per_trade, allocatable, TEST_SHARE_FLOOR)
    out = df.withColumns({"_val": val, "_test": test, "_train": (allocatable - val - test).cast("long")})
    reason = (
        F.when(n < needed, "too_few_bars")
        .when(F.col("_val") + F.col("_test") > allocatable * max_share, "held_out_share")
        .when(F.col("_train") < train_floor, "train_floor")
    )
    out = out.withColumn("split_reason", reason)
    ok = F.col("split_reason").isNull()
    return out.withColumns(
        {f"n_{part}": F.when(ok, F.col(f"_{part}")) for part in ("train", "val", "test")}
    ).drop("_val", "_test", "_train")


def split_bounds(df: DataFrame, embargo: Column | int) -> DataFrame:
    """Half-open position ranges of the three blocks, with the gaps left out."""
    embargo = embargo if isinstance(embargo, Column) else F.lit(embargo)
    val_lo = F.col("n_train") + embargo
    test_lo = val_lo + F.col("n_val") + embargo
    return df.withColumns(
        {
            "val_lo": val_lo,
            "val_hi": val_lo + F.col("n_val"),
            "test_lo": test_lo,
            "test_hi": test_lo + F.col("n_test"),
        }
    )


def temporal_split(df: DataFrame, swing: Column | int, embargo: Column | int, split_swing: Column | int | None = None) -> DataFrame:
    """Label each bar ``train``, ``val``, ``test`` or NULL (gap, or no split possible).

    ``pos`` is the position inside the block. ``rn`` and ``n_bars``, if present, must
    count the rows given.
    """
    if "rn" not in df.columns:
        df = with_position(df)
    base = df.columns
    out = split_bounds(split_sizes(df, swing if split_swing is None else split_swing, embargo), embargo)
    rn = F.col("rn")
    label = (
        F.when(rn < F.col("n_train"), "train")
        .when((rn >= F.col("val_lo")) & (rn < F.col("val_hi")), "val")
        .when((rn >= F.col("test_lo")) & (rn < F.col("test_hi")), "test")
    )
    first = F.when(F.col("split") == "val", F.col("val_lo")).when(F.col("split") == "test", F.col("test_lo")).otherwise(0)
    return out.withColumn("split", label).withColumn("pos", rn - first).select(*base, "split", "pos")


def min_val_trades(n_val: Column, swing: Column | int, factor: Column | int, floor: int = VAL_TRADES_FLOOR) -> Column:
    """Half of the trades one would expect in the validation block, at least ``floor``."""
    per_trade = (swing if isinstance(swing, Column) else F.lit(swing)) * factor
    return F.greatest(F.lit(floor), F.floor(F.try_divide(n_val, per_trade) * 0.5)).cast("long")
