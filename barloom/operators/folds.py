"""Expanding walk-forward folds and the bars that belong to them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.asof import asof_join
from barloom.operators.splits import split_sizes
from barloom.schemas import SERIES_KEYS

JOIN_ROWS = 65_536  # positions per join slot of the folds x bars range join


def fold_windows(bars: DataFrame, window_months: int, step_months: int, keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """Out-of-sample windows ``[start, end)`` per series, numbered from zero.

    Starts step month by month from the first bar, each from the previous one (so a
    31st that became a 28th stays there). The last window ends at or before the last bar.
    """
    keys = list(keys)
    step = F.make_ym_interval(F.lit(0), F.lit(step_months))
    span = bars.groupBy(*keys).agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    count = F.greatest(F.floor(F.months_between("_hi", "_lo") / step_months), F.lit(0)).cast("int") + 1
    starts = F.aggregate(
        F.sequence(F.lit(1), count),
        F.array(F.col("_lo") + step),
        lambda acc, _: F.concat(acc, F.array(F.element_at(acc, -1) + step)),
    )
    window = F.make_ym_interval(F.lit(0), F.lit(window_months))
    return (
        span.select(*keys, "_hi", F.posexplode(starts).alias("fold", "start"))
        .withColumn("end", F.col("start") + window)
        .filter((F.col("start") < F.col("_hi")) & (F.col("end") <= F.col("_hi")))
        .drop("_hi")
    )


def fold_bounds(
    bars: DataFrame,
    windows: DataFrame,
    swing: Column | int,
    embargo_days: int | None = None,
    embargo_bars: int | None = None,
    keys: Sequence[str] = SERIES_KEYS,
    run_keys: Sequence[str] = (),
) -> DataFrame:
    """Position ranges of the train, validation and out-of-sample part of every fold.

    The prior data ends ``embargo_days`` before the window; inside it the train and
    validation block are ``embargo_bars`` apart (both default to ``swing``).
    ``skipped_reason`` is set where the prior data or the window is too short. ``windows`` may
    repeat per ``run_keys``, of which ``swing`` may be one.
    """
    keys, run_keys = list(keys), list(run_keys)
    number = lambda v: v if isinstance(v, Column) else F.lit(v)
    embargo_days = number(swing if embargo_days is None else embargo_days)
    embargo_bars = number(swing if embargo_bars is None else embargo_bars)
    instant = F.expr("INTERVAL '0.000001' SECOND")
    cuts = windows.select(
        *keys,
        *run_keys,
        "fold",
        "start",
        "end",
        F.explode(
            F.array(
                F.struct(F.lit("prior").alias("cut"), (F.col("start") - F.make_dt_interval(embargo_days)).alias("at")),
                F.struct(F.lit("lo").alias("cut"), F.col("start").alias("at")),
                F.struct(F.lit("hi").alias("cut"), F.col("end").alias("at")),
            )
        ).alias("_c"),
    ).select(*keys, *run_keys, "fold", "start", "end", F.col("_c.cut").alias("cut"), (F.col("_c.at") - instant).alias("ts"))
    # Bars strictly before a cut = position of the latest bar before it, plus one.
    found = asof_join(cuts, bars.select(*keys, "ts", "rn"), ["rn"], timedelta(0), keys)
    before = F.coalesce(F.col("rn") + 1, F.lit(0))
    wide = found.groupBy(*keys, *run_keys, "fold", "start", "end").agg(
        *[F.max(F.when(F.col("cut") == cut, before)).alias(name)
          for cut, name in (("prior", "n_prior"), ("lo", "oos_lo"), ("hi", "oos_hi"))]
    )
    sized = split_sizes(wide, swing, embargo_bars, n_bars="n_prior", test_trades=None)
    short = F.col("split_reason").isNotNull() | (F.col("oos_hi") - F.col("oos_lo") < 2 * swing)
    return sized.select(
        *keys,
        *run_keys,
        "fold",
        "start",
        "end",
        "n_prior",
        "n_train",
        (F.col("n_train") + embargo_bars).alias("val_lo"),
        (F.col("n_train") + embargo_bars + F.col("n_val")).alias("val_hi"),
        "oos_lo",
        "oos_hi",
        F.when(short, "insufficient_prior_data").alias("skipped_reason"),
    )


def number_used_blocks(windows: DataFrame, keys: Sequence[str], n_blocks: int) -> DataFrame:
    """Add ``block0``: blocks of the run before this used window (few rows per run)."""
    order = Window.partitionBy(*list(keys)).orderBy("fold")
    return windows.withColumn("block0", ((F.row_number().over(order) - 1) * n_blocks).cast("long"))


def fold_slices(
    bars: DataFrame,
    bounds: DataFrame,
    parts: Sequence[str] = ("val", "oos"),
    columns: Sequence[str] = ("ts", "close", "atr_14", "target", "close_ahead"),
    swing: Column | int = 10,
    keys: Sequence[str] = SERIES_KEYS,
) -> DataFrame:
    """Bars of the wanted parts of every usable fold, with the position in the slice.

    ``keys`` are those of ``bounds``; bars may hold several rows per key and position, told apart by carried ``columns``.

    The range join runs on ``(series, slot)``: a range is copied to the slots of
    ``JOIN_ROWS`` positions it covers, so a long series is spread over its slots and no bar
    meets a fold it does not belong to, up to the slot grain. ``exit_close`` is the
    close ``swing`` bars on, or the last close of the slice.
    """
    keys = list(keys)
    ends = {"train": (F.lit(0).cast("long"), F.col("n_train")), "val": (F.col("val_lo"), F.col("val_hi")),
            "oos": (F.col("oos_lo"), F.col("oos_hi"))}
    ranges = bounds.filter("skipped_reason IS NULL").select(
        *keys,
        "fold",
        F.explode(
            F.array(*[F.struct(F.lit(p).alias("part"), ends[p][0].alias("lo"), ends[p][1].alias("hi")) for p in parts])
        ).alias("_r"),
    ).select(*keys, "fold", "_r.*")
    # The last close of each slice: an equi-join on the position, which exists for every range, so
    # the few ranges can be the small side.
    last = bars.select(*keys, F.col("rn").alias("_at"), F.col("close").alias("_last_close"))
    ranges = ranges.withColumn("_at", F.col("hi") - 1).join(last, [*keys, "_at"]).drop("_at")
    if not set(SERIES_KEYS) >= set(keys):
        ranges = ranges.dropDuplicates([*keys, "fold", "part"])
    slotted = ranges.withColumn(
        "_slot", F.explode(F.sequence(F.expr(f"lo div {JOIN_ROWS}"), F.expr(f"(hi - 1) div {JOIN_ROWS}")))
    )
    exit_close = F.when(F.col("rn") + swing < F.col("hi"), F.col("close_ahead")).otherwise(F.col("_last_close"))
    carried = [c for c in dict.fromkeys(columns) if c != "close_ahead"]
    return (
        bars.withColumn("_slot", F.expr(f"rn div {JOIN_ROWS}"))
        .join(slotted, [*keys, "_slot"])
        .filter("rn >= lo AND rn < hi")
        .select(
            *keys, "fold", "part", (F.col("rn") - F.col("lo")).alias("pos"), "rn", *carried, exit_close.alias("exit_close")
        )
    )
