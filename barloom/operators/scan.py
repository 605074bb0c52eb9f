"""Scans over a blocked series: geometric recurrences, running sums, forward fill.

All functions expect the columns ``_blk`` and ``_sub`` of ``layout.with_halo``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.layout import SUB_ROWS, block_window, sub_window
from barloom.schemas import SERIES_KEYS

# exp(-745) is the smallest positive double: an older term adds exactly zero.
UNDERFLOW_EXPONENT = 745.0


def memory_rows(*decays: float) -> int:
    """Rows after which a chain of recurrences has forgotten its start.

    ``d^rows`` is below the smallest double, so a block that starts this many rows
    early gives the values of the unbounded recurrence. Rounded up to sub-blocks.
    """
    rows = sum(math.ceil(UNDERFLOW_EXPONENT / -math.log(decay)) for decay in decays)
    whole = max(SUB_ROWS, sub_rows(decays))
    return math.ceil(rows / whole) * whole


def sub_rows(decays: Sequence[float]) -> int:
    """Length of a sub-block that suits all of some decays, a power of two.

    The fastest decay bounds it: ``d^-rows`` must stay a double. A slow one is carried over fewer, longer
    sub-blocks.
    """
    longest = 600.0 / max(-math.log(decay) for decay in decays)
    return 1 << max(0, math.floor(math.log2(longest))) if not 1.0 <= longest / SUB_ROWS < 32.0 else SUB_ROWS


def linear_recurrence(
    df: DataFrame,
    recurrences: Mapping[str, tuple[Column, float]],
    keys: Sequence[str] = SERIES_KEYS,
) -> DataFrame:
    """Add columns ``y_t = d * y_{t-1} + e_t`` for each ``name: (e, d)``, ``0 < d < 1``.

    A recurrence starts from zero, so a seed is an ``e`` of the seed value at its
    first row and zero before it. ``df`` is blocked with at least
    ``memory_rows(d)`` halo rows.

    Inside a sub-block the recurrence is ``d^k * sum(e * d^-k)``, a plain growing
    sum. The carry into a sub-block is read by fixed-offset lags from the ends of
    the few preceding sub-blocks that are not yet below the smallest double. All
    windows share one sort and no shuffle or join is added.
    """
    keys = list(keys)
    names = list(recurrences)
    for name, (_, decay) in recurrences.items():
        if not 0.0 < decay < 1.0:
            raise ValueError(f"{name}: decay {decay} is not between 0 and 1")
    size = sub_rows([decay for _, decay in recurrences.values()])
    given = df
    if size != SUB_ROWS:
        df = df.withColumn("_sub", F.expr(f"rn div {size}"))
    sub, block = sub_window(keys), block_window(keys)
    growing = sub.rowsBetween(Window.unboundedPreceding, 0)
    local, reach = [], {}
    for name, (term, decay) in recurrences.items():
        rate = -math.log(decay)
        up = F.expr(f"pow({float(decay)!r}D, _sub * {size} - rn)")
        down = F.expr(f"pow({float(decay)!r}D, rn - _sub * {size})")
        local.append(F.sum(F.coalesce(term, F.lit(0.0)) * up).over(growing) * down)
        reach[name] = math.ceil(UNDERFLOW_EXPONENT / (rate * size))
    # One array of all recurrences: one lag per preceding sub-block serves them all.
    out = df.withColumn("_local", F.array(*local))
    ends = {
        f"_end{back}": F.lag("_local", 1 + back * size).over(block)
        for back in range(max(reach.values()))
    }
    out = out.withColumns(ends)
    # Expressions as SQL text: one parse instead of a driver call per term.
    carries = []
    for i, name in enumerate(names):
        decay = recurrences[name][1]
        terms = [f"coalesce(_end{back}[{i}] * {float(decay ** (back * size))!r}D, 0D)" for back in range(reach[name])]
        carries.append(" + ".join(reversed(terms)))
    entry = F.expr(f"CASE WHEN rn = _sub * {size} THEN array({', '.join(carries)}) END")
    out = out.withColumn("_carry", F.first(entry).over(growing))
    final = {
        name: F.expr(
            f"_local[{i}] + coalesce(_carry[{i}], 0D) * pow({float(recurrences[name][1])!r}D, rn - _sub * {size} + 1)"
        )
        for i, name in enumerate(names)
    }
    out = out.withColumns(final).drop("_local", "_carry", *ends)
    return out if size == SUB_ROWS else out.withColumn("_sub", F.expr(f"rn div {SUB_ROWS}")).select(*given.columns, *names)


def running_sum(
    df: DataFrame, sums: Mapping[str, Column], keys: Sequence[str] = SERIES_KEYS, totals_of: DataFrame | None = None
) -> DataFrame:
    """Add sums over the whole history of the series (no halo rows in ``df``).

    In-block sums plus the total of the earlier blocks, which travels in a table
    with one row per block. ``totals_of`` has the same blocks and inputs without the other columns of ``df``, so
    that these are not computed twice.
    """
    keys = list(keys)
    growing = block_window(keys).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({f"_l_{name}": F.sum(term).over(growing) for name, term in sums.items()})
    totals = (df if totals_of is None else totals_of).groupBy(*keys, "_blk").agg(*[F.sum(term).alias(name) for name, term in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        *keys,
        "_blk",
        *[F.coalesce(F.sum(name).over(before), F.lit(0.0)).alias(f"_c_{name}") for name in sums],
    )
    final = {name: F.col(f"_l_{name}") + F.col(f"_c_{name}") for name in sums}
    scratch = [f"_{kind}_{name}" for kind in "lc" for name in sums]
    return out.join(carries, [*keys, "_blk"]).withColumns(final).drop(*scratch)


def ema_term(x: Column, n: int, first: int, growing_mean: Column) -> tuple[Column, float]:
    """Term and decay of an EMA of ``n`` seeded with the mean of its first ``n`` values.

    ``first`` is the position of the first defined ``x``; ``growing_mean`` its mean
    over the block so far, which at the seed row is the mean of those ``n``.
    """
    alpha = 2.0 / (n + 1)
    seed = first + n - 1
    rn = F.col("rn")
    return F.when(rn < seed, 0.0).when(rn == seed, growing_mean).otherwise(x * alpha), 1.0 - alpha


def rma_term(x: Column, n: int, first: int) -> tuple[Column, float]:
    """Wilder average of ``n`` seeded with the first value."""
    rn = F.col("rn")
    return F.when(rn < first, 0.0).when(rn == first, x).otherwise(x / n), (n - 1) / n


def forward_fill(
    df: DataFrame, column: str, keys: Sequence[str] = SERIES_KEYS, out: str | None = None
) -> DataFrame:
    """Last non-null value of ``column`` at or before each row (no halo rows in ``df``).

    In-block fill plus the last value of the nearest earlier block that has one.
    """
    keys = list(keys)
    growing = block_window(keys).rowsBetween(Window.unboundedPreceding, 0)
    ends = df.groupBy(*keys, "_blk").agg(
        F.max_by(column, F.when(F.col(column).isNotNull(), F.col("rn"))).alias("_end")
    )
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_blk", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    filled = F.coalesce(F.last(column, ignorenulls=True).over(growing), F.col("_carry"))
    return df.join(carry, [*keys, "_blk"]).withColumn(out or column, filled).drop("_carry")
