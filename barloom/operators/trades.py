"""Sequential trades as set operations.

One position at a time: a bar whose score reaches the threshold opens a trade and
the next ``swing`` bars are skipped. The scan is sequential, but what one block of a
run hands to the next is only the number of bars still to skip. So every block
computes, for each possible entry state, its exit state; these maps are composed
over blocks (and blocks of blocks), and each block then picks its trades knowing
its entry state. No run is ever collected whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.layout import block_window, drop_halo, drop_layout, with_halo

FOLD_ROWS = 16_384  # positions per block
FAN = 1_024  # blocks per block of blocks
PIECE = 128  # candidates whose picks are gathered together

# Threshold grids (first, last, step) per formulation, and the
# half-open grid of the production search.
BINARY_GRID = (0.50, 0.85, 0.01)
MULTICLASS_GRID = (0.25, 0.70, 0.01)
REGRESSION_GRID = (-0.0035, 0.0070, 0.0003)


def threshold_grid(first: float, last: float, step: float, inclusive: bool = True) -> list[float]:
    """Evenly spaced thresholds, with or without the last one."""
    stop = last + step / 2.0 if inclusive else last
    spacing = (first + step) - first
    return [first + i * spacing for i in range(math.ceil((stop - first) / step))]


def bars_of(swing: Column | int) -> Column:
    """The cooldown as a column: a number, or a key column of the run."""
    return swing if isinstance(swing, Column) else F.lit(swing)


def with_exit_close(bars: DataFrame, swing: int, keys: Sequence[str], pos: str = "rn") -> DataFrame:
    """Add ``close_ahead``, the close ``swing`` bars later (NULL past the series end)."""
    out = with_halo(bars, fwd=swing, pos=pos)
    return drop_layout(
        drop_halo(out.withColumn("close_ahead", F.lead("close", swing).over(block_window(keys, pos))))
    )


def trade_return(
    tp: Column | float, sl: Column | float, exit_close: Column, cost: float = 0.0, payoff: str = "ternary"
) -> Column:
    """Net return of a trade opened at this bar.

    ``ternary``: barrier distance, or the market exit when neither is hit.
    ``binary``: everything but a take profit counts as a full stop.
    """
    close, atr, target = F.col("close"), F.col("atr_14"), F.col("target")
    tp, sl = (x if isinstance(x, Column) else F.lit(float(x)) for x in (tp, sl))
    guarded = F.when(close != 0, close)
    gain, stop = F.try_divide(atr * tp, guarded), -F.try_divide(atr * sl, guarded)
    if payoff == "binary":
        return F.when(target == 1, gain).otherwise(stop) - cost
    if payoff != "ternary":
        raise ValueError(f"unknown payoff {payoff!r}")
    market = F.try_divide(exit_close - close, guarded)
    return F.when(target == 1, gain).when(target == -1, stop).otherwise(market) - cost


def round_trip_cost(fee_rate: float, slippage: float) -> float:
    return 2.0 * fee_rate + 2.0 * slippage


def gain_and_loss(ret: Column, target: Column) -> tuple[Column, Column]:
    """Contribution to gross profit and gross loss: by outcome, a timeout by sign."""
    gain = F.when(target == 1, ret).when(target == -1, 0.0).otherwise(F.greatest(ret, F.lit(0.0)))
    loss = F.when(target == -1, F.abs(ret)).when(target == 1, 0.0).otherwise(F.greatest(-ret, F.lit(0.0)))
    return gain, loss


def cooldown_picks(
    candidates: DataFrame,
    keys: Sequence[str],
    swing: Column | int,
    payload: Sequence[str],
    pos: str = "pos",
) -> DataFrame:
    """Picks of the sequential scan: one row per ``(keys, _blk)`` with an array ``picks``.

    ``candidates`` holds only bars that may open a trade; ``pos`` counts all bars of
    the run. ``swing`` may be a key column of the run.
    """
    keys = list(keys)
    blocks = _blocks(candidates, keys, payload, pos)
    blocks = blocks.join(_entries(_exits(blocks, keys, "_cands", swing, pos), keys, swing), [*keys, "_blk"])
    picks = _picked("_cands", F.col("_blk") * FOLD_ROWS + F.col("_entry"), swing, pos)
    return blocks.select(*keys, "_blk", picks.alias("picks"))


def _blocks(candidates: DataFrame, keys: list[str], payload: Sequence[str], pos: str) -> DataFrame:
    """One row per block with the sorted array ``_cands``."""
    return (
        candidates.select(*keys, F.expr(f"{pos} div {FOLD_ROWS}").alias("_blk"), F.struct(pos, *payload).alias("_c"))
        .groupBy(*keys, "_blk")
        .agg(F.array_sort(F.collect_list("_c")).alias("_cands"))
    )


def _picked(cands: str | Column, free: Column, swing: Column | int, pos: str) -> Column:
    """The candidates of one block that the scan takes, as an array.

    Picks are gathered in pieces of ``PIECE`` candidates and flattened once, so that a long block
    is not copied for each pick.
    """
    cands = F.col(cands) if isinstance(cands, str) else cands
    nothing = F.filter(cands, lambda c: F.lit(False))
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(cands) - 1) / PIECE), F.lit(0)).cast("int")),
        lambda i: F.slice(cands, i * PIECE + 1, F.lit(PIECE)),
    )

    def take(state: Column, c: Column) -> Column:
        opened = F.struct(
            (c[pos] + swing).cast("long").alias("free"), F.concat(state["picks"], F.array(c)).alias("picks")
        )
        return F.when(c[pos] >= state["free"], opened).otherwise(state)

    def piece(state: Column, own: Column) -> Column:
        start = F.struct(state["free"].alias("free"), nothing.alias("picks"))
        done = F.aggregate(own, start, take)
        return F.struct(done["free"].alias("free"), F.concat(state["picks"], F.array(done["picks"])).alias("picks"))

    begin = F.struct(free.cast("long").alias("free"), F.filter(F.array(nothing), lambda x: F.lit(False)).alias("picks"))
    return F.flatten(F.aggregate(pieces, begin, piece, lambda state: state["picks"]))


def _exits(blocks: DataFrame, keys: Sequence[str], cands: str | Column, swing: Column | int, pos: str) -> DataFrame:
    """``_map`` of each block: the bars still to skip at its end, for each number at its start."""
    cands = F.col(cands) if isinstance(cands, str) else cands
    first = F.col("_blk") * FOLD_ROWS
    entry_states = F.transform(F.sequence(F.lit(0), bars_of(swing) - 1), lambda e: first + e)

    def step(free: Column, c: Column) -> Column:
        return F.transform(free, lambda f: F.when(c[pos] >= f, c[pos] + swing).otherwise(f).cast("long"))

    exits = F.aggregate(cands, entry_states, step)
    left = F.transform(exits, lambda f: F.greatest(f - (first + FOLD_ROWS), F.lit(0)).cast("long"))
    return blocks.select(*keys, "_blk", F.expr(f"_blk div {FAN}").alias("_super"), left.alias("_map"))


def _entries(maps: DataFrame, keys: list[str], swing: Column | int) -> DataFrame:
    """Bars still to skip at the start of every block that has candidates."""
    groups = maps.groupBy(*keys, "_super").agg(F.array_sort(F.collect_list(F.struct("_blk", "_map"))).alias("_maps"))
    whole = F.transform(
        F.sequence(F.lit(0), bars_of(swing) - 1),
        lambda e: _compose("_maps", "_blk", F.col("_super") * FAN, e, F.col("_super") * FAN + FAN),
    )
    tops = (
        groups.select(*keys, "_super", whole.alias("_map"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_super", "_map"))).alias("_maps"))
        .select(*keys, F.explode(_trace("_maps", "_super", F.lit(0).cast("long"), F.lit(0).cast("long"))).alias("_t"))
        .select(*keys, F.col("_t.idx").alias("_super"), F.col("_t.state").alias("_super_entry"))
    )
    return (
        groups.join(tops, [*keys, "_super"])
        .select(*keys, F.explode(_trace("_maps", "_blk", F.col("_super") * FAN, F.col("_super_entry"))).alias("_t"))
        .select(*keys, F.col("_t.idx").alias("_blk"), F.col("_t.state").alias("_entry"))
    )


def _advance(state: Column, at: Column, item: Column, index: str) -> Column:
    """Entry state of ``item`` given the state at block ``at``; an absent block clears it."""
    return F.when(item[index] > at, F.lit(0).cast("long")).otherwise(state)


def _apply(item: Column, entry: Column) -> Column:
    return F.element_at(item["_map"], (entry + 1).cast("int"))


def _compose(maps: str, index: str, first: Column, entry: Column, end: Column) -> Column:
    """Exit state at ``end`` after running through all maps from ``entry``."""
    start = F.struct(first.cast("long").alias("at"), entry.cast("long").alias("state"))

    def step(acc: Column, item: Column) -> Column:
        entered = _advance(acc["state"], acc["at"], item, index)
        return F.struct((item[index] + 1).cast("long").alias("at"), _apply(item, entered).alias("state"))

    return F.aggregate(
        maps, start, step, lambda acc: F.when(acc["at"] < end, F.lit(0).cast("long")).otherwise(acc["state"])
    )


def _trace(maps: str, index: str, first: Column, entry: Column) -> Column:
    """Array of ``(idx, state)``: the entry state of every map in turn."""
    empty = F.expr("filter(array(struct(0L AS idx, 0L AS state)), x -> false)")
    start = F.struct(first.cast("long").alias("at"), entry.cast("long").alias("state"), empty.alias("seen"))

    def step(acc: Column, item: Column) -> Column:
        entered = _advance(acc["state"], acc["at"], item, index)
        seen = F.concat(
            acc["seen"], F.array(F.struct(item[index].cast("long").alias("idx"), entered.alias("state")))
        )
        return F.struct(
            (item[index] + 1).cast("long").alias("at"), _apply(item, entered).alias("state"), seen.alias("seen")
        )

    return F.aggregate(maps, start, step, lambda acc: acc["seen"])


def cooldown_select(
    candidates: DataFrame,
    keys: Sequence[str],
    swing: Column | int,
    payload: Sequence[str],
    pos: str = "pos",
) -> DataFrame:
    """The picked candidates as rows: ``keys, pos`` and the payload."""
    picks = cooldown_picks(candidates, keys, swing, payload, pos)
    return picks.select(*keys, F.explode("picks").alias("_p")).select(*keys, "_p.*")


def naive_trades(bars: DataFrame, swing: Column | int, pos: str = "pos") -> DataFrame:
    """Every bar is a candidate: the picks are every ``swing``-th bar of the run."""
    return bars.filter(F.pmod(F.col(pos), bars_of(swing)) == 0)


def threshold_search(
    scored: DataFrame,
    keys: Sequence[str],
    swing: Column | int,
    thresholds: Sequence[float] | Column,
    min_trades: Column | int,
    pos: str = "pos",
    score: str = "score",
    ret: str = "ret",
) -> DataFrame:
    """Best threshold per run: highest net return, ties (within 1e-12) to the lowest.

    A bar travels once, in the array of its block; each threshold filters that array inside the block. What
    is exchanged per threshold are the blocks' maps and sums. Runs without a threshold that
    trades often enough get NULL. ``thresholds`` may be an array column of the run keys; ``min_trades`` may use the
    run keys and ``n_rows``, the length of the run.
    """
    keys = list(keys)
    grid = thresholds if isinstance(thresholds, Column) else F.lit([float(t) for t in thresholds])
    wanted = scored.filter(F.col(score) >= F.array_min(grid)).withColumns({"_score": F.col(score), "_ret": F.col(ret)})
    blocks = _blocks(wanted, keys, ["_score", "_ret"], pos)

    def reaching(threshold: Column) -> Column:
        return F.filter("_cands", lambda c: c["_score"] >= threshold)

    each = blocks.withColumn("threshold", F.explode(grid))
    maps = _exits(each, [*keys, "threshold"], reaching(F.col("threshold")), swing, pos)
    entries = _entries(maps, [*keys, "threshold"], swing)
    entries = entries.groupBy(*keys, "_blk").agg(F.array_sort(F.collect_list(F.struct("threshold", "_entry"))).alias("_e"))
    started = blocks.join(entries, [*keys, "_blk"]).withColumn("_t", F.explode("_e"))
    picked = _picked(reaching(F.col("_t.threshold")), F.col("_blk") * FOLD_ROWS + F.col("_t._entry"), swing, pos)
    nets = (
        started.select(*keys, F.col("_t.threshold").alias("threshold"), picked.alias("picks"))
        .groupBy(*keys, "threshold")
        .agg(
            F.sum(F.size("picks")).alias("n_trades"),
            F.sum(F.aggregate("picks", F.lit(0.0), lambda acc, p: acc + p["_ret"])).alias("net"),
        )
    )
    runs = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    floor = min_trades if isinstance(min_trades, Column) else F.lit(min_trades)
    best = (
        nets.join(runs, keys)
        .filter(F.col("n_trades") >= floor)
        .groupBy(*keys)
        .agg(
            F.max_by(
                F.struct("threshold", "net", "n_trades"), F.struct(F.round("net", 12), -F.col("threshold"))
            ).alias("_best")
        )
    )
    return runs.join(best, keys, "left").select(
        *keys,
        "n_rows",
        F.col("_best.threshold").alias("threshold"),
        F.col("_best.net").alias("net"),
        F.col("_best.n_trades").alias("n_trades"),
    )


def production_min_trades(swing: Column | int) -> Column:
    """At least ten trades and 15 % of what the run could hold."""
    possible = F.greatest(F.lit(1.0), F.col("n_rows") / bars_of(swing).cast("double"))
    return F.greatest(F.lit(10), F.floor(possible * 0.15))
