"""Row positions and blocks: how one long series is spread over many tasks.

A window ``PARTITION BY symbol, timeframe`` puts a whole series into one task,
and one series may be a third of the table. Every ordered operator here works on
*blocks* of a series instead:

1. ``with_position`` numbers the bars of a series without sorting the series in
   one place: it counts per time bucket (a bucket holds at most ``BLOCK_ROWS``
   bars of its timeframe), accumulates the counts and adds the local row number.
2. ``with_halo`` sends each bar to its block and the few bars next to a block
   edge to the neighbour too, so that any frame of bounded width is complete
   inside one block.

What is still ordered per series is one summary row per ``BLOCK_ROWS`` bars.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.keys import epoch_micros, timeframe_hours
from barloom.schemas import SERIES_KEYS

BLOCK_ROWS = 262_144
SUB_ROWS = 2_048  # sub-blocks bound the exponents of geometric scans


def time_bucket(ts: str = "ts", timeframe: str = "timeframe", rows: int = BLOCK_ROWS) -> Column:
    """Bucket spanning ``rows`` bars of the row's own timeframe."""
    span = (timeframe_hours(F.col(timeframe)) * 3_600_000_000 * rows).cast("long")
    return F.floor(F.try_divide(epoch_micros(F.col(ts)), span)).cast("long")


def with_position(
    df: DataFrame,
    keys: Sequence[str] = SERIES_KEYS,
    ts: str = "ts",
    bucket: Column | None = None,
    name: str = "rn",
    last: str | None = None,
) -> DataFrame:
    """Add the zero-based position ``rn`` and the series length ``n_bars``.

    ``last`` also adds ``last_<col>``, the value of that column in the last bar
    of the series (the exit price of a trade that outlives the data).
    """
    keys = list(keys)
    bucketed = df.withColumn("_tb", time_bucket(ts) if bucket is None else bucket)
    aggs = [F.count(F.lit(1)).alias("_n")]
    if last:
        aggs.append(F.max_by(last, ts).alias("_last"))
    counts = bucketed.groupBy(*keys, "_tb").agg(*aggs)
    series = Window.partitionBy(*keys).orderBy("_tb")
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    cols = [
        *keys,
        "_tb",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(whole).alias("n_bars"),
    ]
    if last:
        cols.append(F.last("_last").over(whole).alias(f"last_{last}"))
    local = Window.partitionBy(*keys, "_tb").orderBy(ts)
    return (
        bucketed.join(counts.select(*cols), [*keys, "_tb"])
        .withColumn(name, F.col("_off") + F.row_number().over(local) - 1)
        .drop("_tb", "_off")
    )


def with_halo(
    df: DataFrame,
    back: int = 0,
    fwd: int = 0,
    pos: str = "rn",
    rows: int = BLOCK_ROWS,
    sub_rows: int = SUB_ROWS,
) -> DataFrame:
    """Add ``_blk``, ``_sub`` and ``_own``; copy edge bars into the next block.

    ``_own`` marks the row in its own block; the copies only feed frames of at
    most ``back`` preceding and ``fwd`` following rows and are dropped with
    ``drop_halo``.
    """
    while rows < max(back, fwd):  # a block is at least as long as the frame
        rows *= 2
    home = F.expr(f"{pos} div {rows}")
    inside = F.expr(f"pmod({pos}, {rows})")
    targets = [home]
    if back:
        targets.append(F.when(inside >= rows - back, home + 1))
    if fwd:
        targets.append(F.when((inside < fwd) & (home > 0), home - 1))
    out = df.withColumn("_home", home).withColumn("_sub", F.expr(f"{pos} div {sub_rows}"))
    if len(targets) == 1:
        out = out.withColumn("_blk", F.col("_home"))
    else:
        out = out.withColumn("_blk", F.explode(F.array_compact(F.array(*targets))))
    return out.withColumn("_own", F.col("_blk") == F.col("_home")).drop("_home")


def block_window(keys: Sequence[str] = SERIES_KEYS, pos: str = "rn") -> WindowSpec:
    """Ordered block of a series. ``_sub`` leads the order so that scans over
    sub-blocks reuse the same sort."""
    return Window.partitionBy(*keys, "_blk").orderBy("_sub", pos)


def sub_window(keys: Sequence[str] = SERIES_KEYS, pos: str = "rn") -> WindowSpec:
    return Window.partitionBy(*keys, "_blk", "_sub").orderBy(pos)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own")


def drop_layout(df: DataFrame) -> DataFrame:
    return df.drop("_blk", "_sub", "_own")
