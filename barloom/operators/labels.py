"""Path-dependent labels: which barrier does the price touch first?

``target`` is +1 (take profit), -1 (stop loss; it wins a tie inside one bar) or 0
(neither within ``swing`` bars, or the series ends). ``target_ret`` is the return
of that exit. ``label_complete`` tells whether all ``swing`` bars exist.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from barloom.functions.keys import epoch_micros, parse_timeframe
from barloom.operators.layout import block_window, drop_halo, drop_layout, with_halo, with_position
from barloom.schemas import SERIES_KEYS


POSITION = ("rn", "n_bars", "last_close")


@dataclass(frozen=True)
class Barrier:
    """Look-ahead in bars and barrier distances in ATR multiples."""

    swing: int = 10
    tp: float = 1.5
    sl: float = 1.0


def _prices(barrier: Barrier) -> tuple[Column, Column]:
    close, atr = F.col("close"), F.col("atr_14")
    return close + atr * barrier.tp, close - atr * barrier.sl


def _exit_return(target: Column, barrier: Barrier, exit_close: Column) -> Column:
    close, atr = F.col("close"), F.col("atr_14")
    guarded = F.when(close != 0, close)
    return (
        F.when(target == 1, F.try_divide(atr * barrier.tp, guarded))
        .when(target == -1, -F.try_divide(atr * barrier.sl, guarded))
        .otherwise(F.try_divide(exit_close - close, guarded))
    )


def _positioned(bars: DataFrame) -> DataFrame:
    """Positions, series length and the last close (exit of an unfinished trade)."""
    if "last_close" in bars.columns:
        return bars
    return with_position(bars.drop("rn", "n_bars"), last="close")


def barrier_labels(bars: DataFrame, barrier: Barrier = Barrier()) -> DataFrame:
    """Label every bar from the bars of its own timeframe (``i+1 .. i+swing``)."""
    keep = [c for c in bars.columns if c not in POSITION]
    labelled = label_grid(bars, [barrier])
    return labelled.select(*keep, *POSITION, "target", "target_ret", "label_complete")


def label_grid(bars: DataFrame, barriers: Sequence[Barrier], payload: Sequence[str] | None = None) -> DataFrame:
    """Labels for several barrier settings: one row per bar and setting.

    The look-ahead reads are shared by all settings; the bars are shuffled once.
    ``payload`` limits the columns carried along.
    """
    reach = max(b.swing for b in barriers)
    w = block_window()
    out = with_halo(_positioned(bars), fwd=reach)
    ahead = {}
    for j in range(1, reach + 1):
        ahead[f"_a{j}"] = F.lead(F.struct("high", "low"), j).over(w)
    for swing in sorted({b.swing for b in barriers}):
        ahead[f"_x{swing}"] = F.coalesce(F.lead("close", swing).over(w), F.col("last_close"))
    out = drop_halo(out.withColumns(ahead))

    settings = []
    for b in barriers:
        # SQL text: one parse instead of four driver calls per look-ahead bar.
        tp, sl = f"close + atr_14 * {float(b.tp)!r}D", f"close - atr_14 * {float(b.sl)!r}D"
        touches = " ".join(
            f"WHEN _a{j}.low <= {sl} THEN -1 WHEN _a{j}.high >= {tp} THEN 1" for j in range(1, b.swing + 1)
        )
        target = F.expr(f"CASE {touches} ELSE 0 END")
        settings.append(
            F.struct(
                F.lit(b.swing).alias("swing"),
                F.lit(float(b.tp)).alias("tp"),
                F.lit(float(b.sl)).alias("sl"),
                target.alias("target"),
                F.col(f"_x{b.swing}").alias("_exit"),
            )
        )
    base = list(payload or [c for c in bars.columns if c not in POSITION])
    needed = [c for c in ("close", "atr_14") if c not in base]
    flat = out.select(*base, *needed, *POSITION, F.explode(F.array(*settings)).alias("_s")).select(
        *base, *needed, *POSITION, "_s.*"
    )
    barrier = Barrier(F.col("swing"), F.col("tp"), F.col("sl"))
    return (
        flat.withColumn("target_ret", _exit_return(F.col("target"), barrier, F.col("_exit")))
        .withColumn("label_complete", F.col("rn") + F.col("swing") < F.col("n_bars"))
        .drop("_exit", *needed)
    )


def first_touch(high: np.ndarray, low: np.ndarray, above: np.ndarray, below: np.ndarray, swing: int) -> np.ndarray:
    """+1, -1 or 0 for each bar: does ``high`` reach ``above`` or ``low`` reach ``below`` first in the next ``swing`` bars?

    Sparse tables hold the extremes of the next 1, 2, 4, ... bars; a binary descent skips the longest stretch without a touch,
    so a bar takes log2(swing) steps. A stop wins a tie; missing values touch nothing.
    """
    n = len(high)
    highs = [np.where(np.isnan(high), -np.inf, high)]
    lows = [np.where(np.isnan(low), np.inf, low)]
    while 1 << len(highs) <= swing:
        half = 1 << (len(highs) - 1)
        for table, worst, best in ((highs, -np.inf, np.maximum), (lows, np.inf, np.minimum)):
            ahead = np.full(n, worst)
            ahead[: max(n - half, 0)] = table[-1][half:]
            table.append(best(table[-1], ahead))
    at, done = np.arange(1, n + 1), np.zeros(n, np.int64)

    def touched(k: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = rows < n
        rows = np.minimum(rows, n - 1)
        return inside & (highs[k][rows] >= above), inside & (lows[k][rows] <= below)

    for k in reversed(range(len(highs))):
        up, down = touched(k, at + done)
        done += ((done + (1 << k) <= swing) & ~(up | down)).astype(np.int64) << k
    up, down = touched(0, at + done)
    return np.where(done >= swing, 0, np.where(down, -1, np.where(up, 1, 0))).astype(np.int32)


def label_sweep(bars: DataFrame, barriers: Sequence[Barrier], timeframes: Sequence[str | None] | None = None) -> DataFrame:
    """Labels for many settings: one row per bar and setting, with ``swing``, ``tp`` and ``sl`` as columns.

    Bars are shuffled once, to their block; the plan is the same for any swing and any number of settings. ``timeframes`` limits a
    setting to the series of one timeframe. ``close_ahead`` is the close ``swing`` bars on, NULL past the end of the series.
    """
    limits = list(timeframes) if timeframes is not None else [None] * len(barriers)
    settings = [(b.swing, float(b.tp), float(b.sl), t) for b, t in zip(barriers, limits, strict=True)]
    base = [c for c in bars.columns if c not in POSITION]
    haloed = with_halo(_positioned(bars), fwd=max(b.swing for b in barriers))
    own = [*base, *(c for c in POSITION if c in haloed.columns)]
    kinds = haloed.select(*own).schema
    schema = StructType([*kinds, *StructType.fromDDL("_s array<struct<swing: int, tp: double, sl: double, target: int, close_ahead: double>>")])
    arrow = to_arrow_schema(schema)

    def touch(table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        mine = [s[:3] for s in settings if s[3] in (None, table["timeframe"][0].as_py())]
        high, low, close, atr = (table[c].to_numpy().astype(np.float64) for c in ("high", "low", "close", "atr_14"))
        n, keep = len(close), table["_own"].to_numpy().astype(bool)
        ahead = {}
        for swing in {s[0] for s in mine}:
            ahead[swing] = np.full(n, np.nan)
            ahead[swing][: max(n - swing, 0)] = close[swing:]
        columns = [
            (np.full(n, swing, np.int32), np.full(n, tp), np.full(n, sl), first_touch(high, low, close + atr * tp, close - atr * sl, swing), ahead[swing])
            for swing, tp, sl in mine
        ]
        flat = [np.stack(c, axis=1)[keep].ravel() for c in zip(*columns, strict=True)] if mine else [np.zeros(0)] * 5
        kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64()]
        values = [pa.array(v, k, from_pandas=k == pa.float64()) for v, k in zip(flat, kinds, strict=True)]
        listed = pa.StructArray.from_arrays(values, ["swing", "tp", "sl", "target", "close_ahead"])
        offsets = pa.array(np.arange(int(keep.sum()) + 1) * len(mine), pa.int32())
        out = table.select(own).filter(pa.array(keep))
        return out.append_column("_s", pa.ListArray.from_arrays(offsets, listed)).cast(arrow)

    labelled = haloed.groupBy(*SERIES_KEYS, "_blk").applyInArrow(touch, schema)
    flat = labelled.withColumn("_s", F.explode("_s")).select(*own, "_s.*")
    barrier = Barrier(F.col("swing"), F.col("tp"), F.col("sl"))
    last = F.coalesce("close_ahead", "last_close")
    return flat.withColumn("target_ret", _exit_return(F.col("target"), barrier, last)).withColumn(
        "label_complete", F.col("rn") + F.col("swing") < F.col("n_bars")
    )


def barrier_labels_ltf(bars: DataFrame, lower: DataFrame, timeframe: str, barrier: Barrier = Barrier()) -> DataFrame:
    """Labels of ``timeframe`` bars resolved on lower-timeframe bars.

    The lower bars of ``[t + 1 bar, t + swing bars]``, both ends included, decide which
    barrier is touched first; the timeout exit stays a bar count. Both sides meet
    on ``(symbol, bar-length slot)``: first with one summary row per slot, which
    drops every slot that touches no barrier, then in detail for the slots left.
    """
    step = int(parse_timeframe(timeframe) * 3_600_000_000)
    tp, sl = _prices(barrier)
    out = drop_layout(
        drop_halo(
            with_halo(_positioned(bars), fwd=barrier.swing).withColumn(
                "_exit", F.coalesce(F.lead("close", barrier.swing).over(block_window()), F.col("last_close"))
            )
        )
    )
    at = epoch_micros(F.col("ts"))
    span = out.select("symbol", at.alias("_at"), tp.alias("_tp"), sl.alias("_sl"))
    slot = F.expr(f"_at div {step}")
    # An unaligned window overlaps one slot more than it has bars.
    windows = span.withColumn(
        "_slot", F.explode(F.sequence(slot + 1, F.expr(f"(_at + {step * barrier.swing}) div {step}")))
    )
    low = lower.select(
        "symbol", epoch_micros(F.col("ts")).alias("_lt"), F.col("high").alias("_hi"), F.col("low").alias("_lo")
    ).withColumn("_slot", F.expr(f"_lt div {step}"))
    summary = low.groupBy("symbol", "_slot").agg(F.max("_hi").alias("_max"), F.min("_lo").alias("_min"))
    touched = windows.join(summary, ["symbol", "_slot"]).filter("_max >= _tp OR _min <= _sl").drop("_max", "_min")
    hits = (
        touched.join(low, ["symbol", "_slot"])
        .filter(f"_lt >= _at + {step} AND _lt <= _at + {step * barrier.swing}")
        .filter("_lo <= _sl OR _hi >= _tp")
        .groupBy("symbol", "_at")
        .agg(F.min_by(F.when(F.col("_lo") <= F.col("_sl"), -1).otherwise(1), "_lt").alias("_first"))
    )
    keep = [c for c in bars.columns if c not in POSITION]
    labelled = out.withColumn("_at", at).join(hits, ["symbol", "_at"], "left")
    target = F.coalesce("_first", F.lit(0))
    return labelled.withColumn("target", target).select(
        *keep,
        *POSITION,
        "target",
        _exit_return(F.col("target"), barrier, F.col("_exit")).alias("target_ret"),
        (F.col("rn") + barrier.swing < F.col("n_bars")).alias("label_complete"),
    )


def extrema_labels(bars: DataFrame, barrier: Barrier = Barrier()) -> DataFrame:
    """Older binary label: the window's maximum reaches the take profit and its
    minimum stays above the stop; 0 where the window is incomplete."""
    base = bars.columns
    frame = block_window().rowsBetween(1, barrier.swing)
    tp, sl = _prices(barrier)
    out = with_halo(bars if "rn" in base else with_position(bars), fwd=barrier.swing)
    whole = F.count("high").over(frame) == barrier.swing
    out = out.withColumns({"_max": F.max("high").over(frame), "_min": F.min("low").over(frame), "_whole": whole})
    hit = F.col("_whole") & (F.col("_max") >= tp) & (F.col("_min") > sl)
    return drop_halo(out).withColumn("target_extrema", F.coalesce(hit, F.lit(False)).cast("int")).select(
        *base, "target_extrema"
    )
