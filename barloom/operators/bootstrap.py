"""Bootstrap of profit-factor differences with a counter-based generator.

A draw is a hash of (seed, iteration, draw number): independent of partitioning,
repeatable after the loss of an executor and computable in any SQL engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.metrics import profit_factor, signed_sums

CHUNK = 50  # iterations per task-sized unit of work


def draw(seed: Column | int, iteration: Column, number: Column, n: Column) -> Column:
    """Uniform integer in ``[0, n)``; the modulo bias is below ``n / 2^32``."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    text = F.concat_ws("|", seed.cast("string"), iteration.cast("string"), number.cast("string"))
    digest = F.md5(text.cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), n.cast("long"))


def block_sums(
    trades: DataFrame, windows: DataFrame, keys: Sequence[str], fold: str = "fold", n_blocks: int = 8
) -> DataFrame:
    """Additive profit-factor parts per time block of every window, empty blocks included.

    ``windows`` has ``keys, fold, start, end`` and ``block0``, the number of earlier
    blocks of the run; ``trades`` has ``keys, fold, side ('model'|'naive'), ts, ret``.
    Block edges are equally spaced in time; a block holds its left edge.
    """
    keys = list(keys)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    part = (
        trades.join(windows.select(*keys, fold, "start", "end"), [*keys, fold])
        .withColumn(
            "_b",
            F.floor((micros("ts") - micros("start")) * n_blocks / (micros("end") - micros("start"))).cast("long"),
        )
        .groupBy(*keys, fold, "_b", "side")
        .agg(*signed_sums())
    )
    flat = part.groupBy(*keys, fold, "_b").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c))), F.lit(0)).alias(f"{side}_{c}")
            for side in ("model", "naive")
            for c in ("gain", "loss", "trades")
        ]
    )
    grid = windows.select(*keys, fold, "block0", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_b"))
    return (
        grid.withColumn("_b", F.col("_b").cast("long"))
        .join(flat, [*keys, fold, "_b"], "left")
        .select(
            *keys,
            (F.col("block0") + F.col("_b")).alias("block"),
            *[
                F.coalesce(F.col(f"{side}_{c}"), F.lit(0).cast("long" if c == "trades" else "double")).alias(
                    f"{side}_{c}"
                )
                for side in ("model", "naive")
                for c in ("gain", "loss", "trades")
            ],
        )
    )


PARTS = ("model_gain", "model_loss", "model_trades", "naive_gain", "naive_loss", "naive_trades")


def paired_block_bootstrap(
    blocks: DataFrame, keys: Sequence[str], n_iter: int = 1000, seed: Column | int = 42
) -> DataFrame:
    """Profit-factor differences of every iteration: ``keys, iteration, delta``.

    Profit factors add up over blocks, so a run is reduced to one small array (a few
    dozen blocks) before resampling; the iterations are spread over tasks in chunks
    and need no further join. The same block numbers serve model and naive side.
    ``seed`` may be a column of the run.
    """
    keys = list(keys)
    runs = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", *PARTS))).alias("_b"))
    chunks = runs.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit((n_iter - 1) // CHUNK))))
    spread = chunks.repartition(*keys, "_chunk").withColumn(
        "iteration",
        F.explode(
            F.sequence(F.col("_chunk") * CHUNK, F.least(F.col("_chunk") * CHUNK + CHUNK, F.lit(n_iter)) - 1)
        ),
    )
    k = F.size("_b")
    zero = F.struct(*[F.lit(0.0).alias(p) for p in PARTS])

    def add(acc: Column, j: Column) -> Column:
        block = F.element_at(F.col("_b"), (draw(seed, F.col("iteration"), j, k) + 1).cast("int"))
        return F.struct(*[(acc[p] + block[p]).alias(p) for p in PARTS])

    total = F.aggregate(F.sequence(F.lit(0), k - 1), zero, add)
    sums = spread.select(*keys, "iteration", total.alias("_t"))
    t = F.col("_t")
    delta = profit_factor(t["model_gain"], t["model_loss"], t["model_trades"]) - profit_factor(
        t["naive_gain"], t["naive_loss"], t["naive_trades"]
    )
    return sums.select(*keys, "iteration", delta.alias("delta"))


def iid_bootstrap(trades: DataFrame, keys: Sequence[str], n_iter: int = 1000, seed: int = 42) -> DataFrame:
    """Per-trade bootstrap with independent draws for the two sides.

    ``trades`` has ``keys, side, idx, ret`` with ``idx`` counting the trades of a side
    from zero. The draws of an iteration come from the trades' own rows, so they are
    spread like the data; each draw then looks up its trade by ``(side, idx)``.
    """
    keys = list(keys)
    sized = trades.groupBy(*keys, "side").agg(F.count(F.lit(1)).alias("_n"))
    draws = (
        trades.select(*keys, "side", F.col("idx").alias("_j"))
        .join(sized, [*keys, "side"])
        .withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))))
        .withColumn("idx", draw(seed, F.concat_ws("|", "side", "iteration"), F.col("_j"), F.col("_n")))
        # Repeated draws of one trade are counted before they travel.
        .groupBy(*keys, "side", "idx", "iteration")
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    r = F.col("ret")
    sums = (
        draws.join(trades.select(*keys, "side", "idx", "ret"), [*keys, "side", "idx"])
        .groupBy(*keys, "iteration")
        .agg(
            *[
                F.sum(F.when((F.col("side") == side) & wins, F.abs(r) * F.col("_times")).otherwise(0.0)).alias(
                    f"{side}_{name}"
                )
                for side in ("model", "naive")
                for name, wins in (("gain", r > 0), ("loss", r < 0))
            ],
            *[
                F.count_if(F.col("side") == side).alias(f"{side}_trades")
                for side in ("model", "naive")
            ],
        )
    )
    delta = profit_factor(F.col("model_gain"), F.col("model_loss"), F.col("model_trades")) - profit_factor(
        F.col("naive_gain"), F.col("naive_loss"), F.col("naive_trades")
    )
    return sums.select(*keys, "iteration", delta.alias("delta"))


def delta_percentiles(deltas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """p5, p50, p95 per run and the number of undefined iterations.

    A run with an undefined iteration has no percentiles, so its gate fails.
    """
    missing = F.count_if(F.col("delta").isNull())
    cut = F.percentile("delta", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return (
        deltas.groupBy(*list(keys))
        .agg(missing.alias("n_null_iters"), cut.alias("_p"))
        .select(
            *list(keys),
            "n_null_iters",
            *[
                F.when(F.col("n_null_iters") == 0, F.col("_p")[i]).alias(name)
                for i, name in enumerate(("p5", "p50", "p95"))
            ],
        )
    )
