"""Indicators of a stream of closed bars, from a state of fixed size per series.

The state of a series holds what its recurrences need and no history: the values of the EMAs and Wilder averages, the running
volume, the last 20 bars, and the bars that wait for the watermark. Bars may arrive in any order within the delay; once the watermark
has passed a bar it is final, and its indicators are those of ``operators.indicators.technicals`` over all final bars. Of equal bars
that wait, the one that lands last counts. A bar behind the watermark, or at or before the last final bar, is late: it is dropped and
counted, by Spark's ``numRowsDroppedByWatermark`` or in ``late``, which each row of the series carries.

A row leaves the stream when it is final. Bars with a missing price or volume are not final bars: they are counted as ``late`` too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.indicators import ALL
from barloom.schemas import SERIES_KEYS

RING = 20
PRICES = ("open", "high", "low", "close", "volume")
#: Numbers of the state: sums of seeds, averages, running volume.
NUMBERS = ("mean", "ema12", "ema26", "ema50", "macd_sum", "signal", "gain", "loss", "atr", "pdm", "mdm", "adx", "obv")
STATE = "n long, last long, late long, numbers array<double>, ring array<double>, raw_k array<double>, wait_at array<long>, wait array<double>"
OUT = f"symbol string, timeframe string, ts timestamp, rn long, late long, {', '.join(f'{c} double' for c in (*PRICES, *ALL))}"


def _ratio(top: float, bottom: float) -> float | None:
    return top / bottom if bottom else None


def _ema(y: float, x: float, rn: int, n: int, first: int, mean: float) -> float:
    """An EMA of ``n`` that starts at ``first + n - 1`` with the mean of its first values."""
    seed = first + n - 1
    alpha = 2.0 / (n + 1)
    return 0.0 if rn < seed else mean if rn == seed else y * (1.0 - alpha) + x * alpha


def _rma(y: float, x: float, rn: int, first: int, n: int = 14) -> float:
    return 0.0 if rn < first else x if rn == first else y * ((n - 1) / n) + x / n


class Series:
    """The indicators of one series, bar by bar."""

    def __init__(self, n: int = 0, numbers: list[float] | None = None, ring: list[float] | None = None, raw_k: list[float] | None = None) -> None:
        self.n = n
        self.of = dict(zip(NUMBERS, numbers or [0.0] * len(NUMBERS), strict=True))
        flat = ring or []
        self.ring = [tuple(flat[i : i + 4]) for i in range(0, len(flat), 4)]
        #: NaN stands for a missing value, which states cannot hold.
        self.raw_k = list(raw_k or [])

    def stored(self) -> tuple[int, list[float], list[float], list[float]]:
        return self.n, [self.of[k] for k in NUMBERS], [v for bar in self.ring for v in bar], self.raw_k

    def add(self, high: float, low: float, close: float, volume: float) -> dict[str, float | None]:
        rn, s = self.n, self.of
        before = self.ring[-1] if self.ring else None
        self.ring = [*self.ring, (high, low, close, volume)][-RING:]
        self.n += 1
        s["mean"] += (close - s["mean"]) / (rn + 1)
        diff = close - before[2] if before else None
        out: dict[str, float | None] = dict.fromkeys(ALL)

        for name, n in (("ema12", 12), ("ema26", 26), ("ema50", 50)):
            s[name] = _ema(s[name], close, rn, n, 0, s["mean"])
        if rn >= 25:
            macd = out["macd"] = s["ema12"] - s["ema26"]
            s["macd_sum"] += macd if rn <= 33 else 0.0
            s["signal"] = _ema(s["signal"], macd, rn, 9, 25, s["macd_sum"] / 9)
            out["macd_hist"] = macd - s["signal"] if rn >= 33 else None
        if rn >= 49:
            out["ema_50"], out["dist_ema_50"] = s["ema50"], _ratio(close - s["ema50"], s["ema50"])

        up = high - before[0] if before else 0.0
        down = before[1] - low if before else 0.0
        moves = (("gain", max(diff or 0.0, 0.0)), ("loss", max(-(diff or 0.0), 0.0)), ("pdm", up if up > down and up > 0 else 0.0), ("mdm", down if down > up and down > 0 else 0.0))
        for name, x in moves:
            s[name] = _rma(s[name], x, rn, 1)
        true_range = max(high - low, abs(high - before[2]), abs(low - before[2])) if before else high - low
        s["atr"] = _rma(s["atr"], true_range, rn, 0)
        if rn >= 13:
            out["atr_14"] = s["atr"]
        if rn >= 14:
            rsi = _ratio(s["gain"], s["gain"] + s["loss"])
            out["rsi_14"] = None if rsi is None else 100.0 * rsi
            dx = _ratio(abs(s["pdm"] - s["mdm"]), s["pdm"] + s["mdm"])
            s["adx"] = _rma(s["adx"], 100.0 * (dx or 0.0), rn, 14)
            out["adx_14"] = s["adx"] if rn >= 27 else None

        if self.n >= 14:
            last = self.ring[-14:]
            low14, high14 = min(b[1] for b in last), max(b[0] for b in last)
            raw = _ratio(close - low14, high14 - low14)
            self.raw_k = [*self.raw_k, math.nan if raw is None else 100.0 * raw][-3:]
            if len(self.raw_k) == 3 and not any(map(math.isnan, self.raw_k)):
                out["stoch_k"] = sum(self.raw_k) / 3
        if self.n >= RING:
            closes = [b[2] for b in self.ring]
            mid = sum(closes) / RING
            dev = math.sqrt(sum((c - mid) ** 2 for c in closes) / (RING - 1))
            out["bb_width"] = None if mid == 0 else 100.0 * (4 * dev) / mid
            out["bb_pos"] = _ratio(close, mid + 2 * dev)
            out["vol_sma_20"] = sum(b[3] for b in self.ring) / RING
            out["rel_volume"] = _ratio(volume, out["vol_sma_20"])
        s["obv"] += volume if diff is None else math.copysign(volume, diff) if diff else 0.0
        out["obv"] = s["obv"]
        return out


class Indicators(StatefulProcessor):
    """One state per series; one timer, at its earliest waiting bar."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", STATE)

    def _load(self) -> tuple[Series, int, int, dict[int, tuple]]:
        if not self.state.exists():
            return Series(), -1, 0, {}
        n, last, late, numbers, ring, raw_k, wait_at, wait = self.state.get()
        width = len(PRICES)
        waiting = {at: tuple(wait[i * width : (i + 1) * width]) for i, at in enumerate(wait_at)}
        return Series(n, list(numbers), list(ring), list(raw_k)), last, late, waiting

    def _save(self, series: Series, last: int, late: int, waiting: dict[int, tuple]) -> None:
        n, numbers, ring, raw_k = series.stored()
        at = sorted(waiting)
        self.state.update((n, last, late, numbers, ring, raw_k, at, [v for t in at for v in waiting[t]]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        series, last, late, waiting = self._load()
        timer = min(waiting, default=None)
        for pdf in rows:
            # Timers count milliseconds.
            stamps = pdf["ts"].astype("datetime64[ms]").astype("int64").tolist()
            for at, *bar in zip(stamps, *(pdf[c].tolist() for c in PRICES), strict=True):
                if at <= last or any(v is None or math.isnan(v) for v in bar[1:]):
                    late += 1
                else:
                    waiting[at] = tuple(math.nan if v is None else v for v in bar)
        self._save(series, last, late, waiting)
        if waiting and timer != (first := min(waiting)):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        series, last, late, waiting = self._load()
        mark = timerValues.getCurrentWatermarkInMs()
        out = []
        for at in sorted(t for t in waiting if t <= mark):
            opened, high, low, close, volume = waiting.pop(at)
            last = at
            found = series.add(high, low, close, volume)
            out.append({**dict(zip(SERIES_KEYS, key, strict=True)), "ts": pd.Timestamp(at, unit="ms"), "rn": series.n - 1, "late": late,
                        "open": opened, "high": high, "low": low, "close": close, "volume": volume, **found})
        self._save(series, last, late, waiting)
        if waiting:
            self.handle.registerTimer(min(waiting))
        yield pd.DataFrame(out, columns=[*SERIES_KEYS, "ts", "rn", "late", *PRICES, *ALL]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


#: Python states need the RocksDB store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_indicators(bars: DataFrame, delay: str = "2 days") -> DataFrame:
    """A stream of closed bars (``schemas.BAR``) to a stream of final bars with all technicals, ``rn`` and ``late``."""
    bars.sparkSession.conf.set(*STORE)
    timed = bars.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    out = timed.groupBy(*SERIES_KEYS).transformWithStateInPandas(
        statefulProcessor=Indicators(), outputStructType=OUT, outputMode="Append", timeMode="EventTime"
    )
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
