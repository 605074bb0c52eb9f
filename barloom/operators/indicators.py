"""Technical indicators as blocked windows and scans.

One shuffle lays the bars out in blocks that start ``HALO_BACK`` bars early; all
bounded frames and all recurrences share its one sort. Only the on-balance volume,
which never forgets, needs a carry table.
Zero denominators give NULL. Seeds: an EMA starts with the mean of its first
``n`` values, a Wilder average with its first value and is NULL before ``n``
observations. Bollinger bands use the sample deviation.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.layout import (
    block_window,
    drop_halo,
    drop_layout,
    with_halo,
    with_position,
)
from barloom.operators.scan import ema_term, linear_recurrence, memory_rows, rma_term, running_sum
from barloom.schemas import SERIES_KEYS

# The longest memory: ADX averages an average of 14. Frames read at most 20 rows.
HALO_BACK = memory_rows(13 / 14, 13 / 14)

MOMENTUM = ("rsi_14", "macd", "macd_hist", "stoch_k")
TREND = ("ema_50", "dist_ema_50", "adx_14")
VOLATILITY = ("atr_14", "bb_width", "bb_pos")
VOLUME = ("obv", "vol_sma_20", "rel_volume")
ALL = MOMENTUM + TREND + VOLATILITY + VOLUME


def _full(value, count_of: str, frame, n: int):
    """``value`` only where its frame holds ``n`` non-null inputs."""
    return F.when(F.count(count_of).over(frame) == n, value)


def _ratio(top, bottom):
    return F.try_divide(top, F.when(bottom != 0, bottom))


def technicals(df: DataFrame, wanted: Iterable[str] = ALL) -> DataFrame:
    """Add the wanted indicator columns to bars of any number of series.

    Columns not needed by ``wanted`` are not computed. The position columns
    ``rn``, ``n_bars`` and ``last_close`` stay, for the operators downstream.
    """
    wanted = tuple(wanted)
    need = set(wanted)
    unknown = need - set(ALL)
    if unknown:
        raise ValueError(f"unknown indicators {sorted(unknown)}; known: {list(ALL)}")
    base = df.columns
    if "rn" not in base:
        df = with_position(df, last="close")
    out = with_halo(df, back=HALO_BACK)
    w = block_window()

    def frame(n):
        return w.rowsBetween(-(n - 1), 0)

    first: dict = {}
    if need & {"rsi_14", "obv"}:
        first["_diff"] = F.col("close") - F.lag("close").over(w)
    if need & {"adx_14"}:
        first["_up"] = F.col("high") - F.lag("high").over(w)
        first["_dn"] = F.lag("low").over(w) - F.col("low")
    if "atr_14" in need:
        previous = F.lag("close").over(w)
        first["_tr"] = F.greatest(
            F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous)
        )
    if need & {"macd", "macd_hist", "ema_50", "dist_ema_50"}:
        first["_mean"] = F.avg("close").over(w.rowsBetween(Window.unboundedPreceding, 0))
    if "stoch_k" in need:
        low, high = F.min("low").over(frame(14)), F.max("high").over(frame(14))
        raw = F.lit(100.0) * _ratio(F.col("close") - low, high - low)
        first["_raw_k"] = _full(raw, "close", frame(14), 14)
    if need & {"bb_width", "bb_pos"}:
        first["_mid"] = _full(F.avg("close").over(frame(20)), "close", frame(20), 20)
        first["_dev"] = _full(F.stddev_samp("close").over(frame(20)), "close", frame(20), 20)
    if need & {"vol_sma_20", "rel_volume"}:
        first["vol_sma_20"] = _full(F.avg("volume").over(frame(20)), "volume", frame(20), 20)
    out = out.withColumns(first)

    second: dict = {}
    if "stoch_k" in need:
        second["stoch_k"] = _full(F.avg("_raw_k").over(frame(3)), "_raw_k", frame(3), 3)
    if need & {"bb_width", "bb_pos"}:
        upper = F.col("_mid") + 2 * F.col("_dev")
        lower = F.col("_mid") - 2 * F.col("_dev")
        second["bb_width"] = F.lit(100.0) * _ratio(upper - lower, F.col("_mid"))
        second["bb_pos"] = _ratio(F.col("close"), upper)
    if need & {"vol_sma_20", "rel_volume"}:
        second["rel_volume"] = _ratio(F.col("volume"), F.col("vol_sma_20"))
    out = drop_halo(_recurrent(out.withColumns(second), need))
    if "obv" in need:
        # The first bar has no predecessor and counts with its full volume.
        moved = F.coalesce(F.signum("_diff"), F.lit(1.0)) * F.col("volume")
        lean = with_halo(df.select(*SERIES_KEYS, "rn", "close", "volume"), back=1)
        lean = drop_halo(lean.withColumn("_diff", F.col("close") - F.lag("close").over(w)))
        out = running_sum(out, {"obv": moved}, totals_of=lean)
    return drop_layout(out.select(*base, *[c for c in df.columns if c not in base], *wanted, "_blk", "_sub"))


def _recurrent(out: DataFrame, need: set[str]) -> DataFrame:
    rn = F.col("rn")
    recurrences: dict = {}
    if need & {"macd", "macd_hist"}:
        recurrences["_ema12"] = ema_term(F.col("close"), 12, 0, F.col("_mean"))
        recurrences["_ema26"] = ema_term(F.col("close"), 26, 0, F.col("_mean"))
    if need & {"ema_50", "dist_ema_50"}:
        recurrences["ema_50"] = ema_term(F.col("close"), 50, 0, F.col("_mean"))
    if "rsi_14" in need:
        recurrences["_gain"] = rma_term(F.greatest(F.col("_diff"), F.lit(0.0)), 14, 1)
        recurrences["_loss"] = rma_term(F.greatest(-F.col("_diff"), F.lit(0.0)), 14, 1)
    if "atr_14" in need:
        recurrences["atr_14"] = rma_term(F.col("_tr"), 14, 0)
    if "adx_14" in need:
        up, down = F.col("_up"), F.col("_dn")
        recurrences["_pdm"] = rma_term(F.when((up > down) & (up > 0), up).otherwise(0.0), 14, 1)
        recurrences["_mdm"] = rma_term(F.when((down > up) & (down > 0), down).otherwise(0.0), 14, 1)
    if recurrences:
        out = linear_recurrence(out, recurrences)

    derived: dict = {}
    if need & {"macd", "macd_hist"}:
        derived["macd"] = F.when(rn >= 25, F.col("_ema12") - F.col("_ema26"))
    if need & {"ema_50", "dist_ema_50"}:
        derived["ema_50"] = F.when(rn >= 49, F.col("ema_50"))
        derived["dist_ema_50"] = F.when(rn >= 49, _ratio(F.col("close") - F.col("ema_50"), F.col("ema_50")))
    if "rsi_14" in need:
        derived["rsi_14"] = F.when(
            rn >= 14, F.lit(100.0) * _ratio(F.col("_gain"), F.col("_gain") + F.col("_loss"))
        )
    if "atr_14" in need:
        derived["atr_14"] = F.when(rn >= 13, F.col("atr_14"))
    if "adx_14" in need:
        # The true range cancels out of |+DI - -DI| / (+DI + -DI).
        moved = F.abs(F.col("_pdm") - F.col("_mdm"))
        derived["_dx"] = F.when(
            rn >= 14, F.coalesce(F.lit(100.0) * _ratio(moved, F.col("_pdm") + F.col("_mdm")), F.lit(0.0))
        )
    out = out.withColumns(derived)

    recurrences = {}
    if "macd_hist" in need:
        growing = block_window().rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("_macd_mean", F.avg("macd").over(growing))
        recurrences["_signal"] = ema_term(F.col("macd"), 9, 25, F.col("_macd_mean"))
    if "adx_14" in need:
        recurrences["adx_14"] = rma_term(F.col("_dx"), 14, 14)
    if recurrences:
        out = linear_recurrence(out, recurrences)
        final: dict = {}
        if "macd_hist" in need:
            final["macd_hist"] = F.when(rn >= 33, F.col("macd") - F.col("_signal"))
        if "adx_14" in need:
            final["adx_14"] = F.when(rn >= 27, F.col("adx_14"))
        out = out.withColumns(final)
    return out


def momentum(df: DataFrame) -> DataFrame:
    return technicals(df, MOMENTUM)


def trend(df: DataFrame) -> DataFrame:
    return technicals(df, TREND)


def volatility(df: DataFrame) -> DataFrame:
    return technicals(df, VOLATILITY)


def volume(df: DataFrame) -> DataFrame:
    return technicals(df, VOLUME)


def ema(df: DataFrame, column: str, n: int, out: str) -> DataFrame:
    """EMA of one column; NULL before ``n`` bars."""
    base = df.columns
    if "rn" not in base:
        df = with_position(df)
    blocked = with_halo(df, back=memory_rows(1.0 - 2.0 / (n + 1)))
    growing = block_window().rowsBetween(Window.unboundedPreceding, 0)
    blocked = blocked.withColumn("_mean", F.avg(column).over(growing))
    scanned = linear_recurrence(blocked, {out: ema_term(F.col(column), n, 0, F.col("_mean"))})
    return drop_halo(scanned).withColumn(out, F.when(F.col("rn") >= n - 1, F.col(out))).select(*base, out)
