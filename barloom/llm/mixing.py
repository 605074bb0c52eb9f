"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Every source has a weight and may be repeated ``max_epochs`` times at most. Targets grow with the
weights until a source reaches its cap; the excess goes to the others by weight. Sorted by
``cap / weight`` a source is capped exactly if the level that the not yet capped ones would reach is
at or above its own ratio, so the fixed point needs one window over the table of sources, no loop.

Inside a source, documents follow each other by ``md5(seed:doc_id)``. Each is taken as often as the
target holds the whole source; what is left is filled in that order, the document at the cut with the
part that still fits. The cut is found by narrowing the key's prefix twice on pre-aggregated sums,
so a source with a third of all rows is never sorted in one task. Only one row per source is joined
back.

Defined cases: a null text has no words (size 0, taken 0); a null source is a source of its own, last
in order; repeated rows share their key, and the part at a cut is divided evenly among them; a null
``doc_id`` is a key like any other; empty tables give empty results. Input columns named like
an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import WORD, word_count
from barloom.session import cut_lineage

#: Above this many sources the plan is joined by shuffle instead of broadcast (a row is under 200 bytes).
BROADCAST_SOURCES = 20_000
#: Hex digits per narrowing round: 4096 sums per source and round.
DIGITS = 3
ROUNDS = 2
OUT = ("size", "source_size", "target", "taken")


def _key(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def targets(
    sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), ratio: float = 1.5, max_epochs: float = 2.0
) -> DataFrame:
    """``sizes`` (source, source_size), one row per source -> source, source_size, target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    index = (F.row_number().over(order) - 1) % len(weights)
    return (
        sizes.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[index])
        .withColumn("cap", F.col("source_size") * float(max_epochs))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("goal", F.sum("source_size").over(everything) * float(ratio))
        .withColumn("left", F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("capped", F.col("left") / F.sum("weight").over(onward) >= F.col("ratio"))
        .withColumn("free", F.col("goal") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0)))
        .withColumn("free_weight", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything))
        .select(
            "source",
            "source_size",
            F.when(F.col("capped"), F.col("cap"))
            .otherwise(F.col("weight") * F.col("free") / F.col("free_weight"))
            .alias("target"),
        )
    )


def mix_plan(docs: DataFrame, seed: int = 42, **rule) -> DataFrame:
    """One row per source: source_size, target, whole repeats, and the key and part at the cut."""
    rows = cut_lineage(docs.select("source", _key(seed).alias("key"), word_count(F.col("text")).alias("size")))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), **rule)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = cut_lineage(
        plan.withColumn("whole", whole.cast("long"))
        .withColumn("room", (F.round("target") - F.col("whole") * F.col("source_size")).cast("long"))
        .withColumn("prefix", F.lit(""))
    )
    for _ in range(ROUNDS):
        plan = cut_lineage(_narrow(rows, plan, DIGITS))
    return cut_lineage(_narrow(rows, plan, None).withColumnsRenamed({"prefix": "cut_key", "room": "part"}))


def _narrow(rows: DataFrame, plan: DataFrame, digits: int | None) -> DataFrame:
    """Lengthen the prefix of the cut by ``digits`` (None: to the whole key) and lower the room to what it leaves."""
    cut = plan.select(F.col("source").alias("cut_source"), "prefix", "room")
    same = F.col("source").eqNullSafe(F.col("cut_source"))
    inside = rows.join(_small(cut.drop("room"), plan), same & F.col("key").startswith(F.col("prefix")))
    step = F.col("key") if digits is None else F.substring("key", 1, F.length("prefix") + digits)
    sums = inside.groupBy("source", step.alias("next")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("next"))
    sums = sums.withColumn("before", running - F.col("words"))
    fits = (F.col("before") <= F.col("room")) & (F.col("room") < F.col("before") + F.col("words"))
    left = F.col("room") - F.col("before")
    found = sums.join(cut.drop("prefix"), same & fits).select(
        "cut_source", "next", (F.floor(left / F.col("rows")) if digits is None else left).cast("long").alias("rest")
    )
    # No hit: the source has no words, so nothing is cut.
    return plan.join(found, same, "left").select(
        "source",
        "source_size",
        "target",
        "whole",
        F.coalesce(F.col("rest"), F.lit(0)).cast("long").alias("room"),
        F.coalesce(F.col("next"), F.col("prefix")).alias("prefix"),
    )


def _small(df: DataFrame, counted: DataFrame) -> DataFrame:
    """Broadcast a table of one row per source if there are few sources; else leave it to the shuffle join."""
    return F.broadcast(df) if counted.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else df


def mix(docs: DataFrame, seed: int = 42, **rule) -> DataFrame:
    """All columns of ``docs`` and size, source_size, target (both of the source), taken."""
    base = docs.drop(*OUT)
    plan = mix_plan(base, seed, **rule)
    plan = plan.select([F.col(c).alias(f"__{c}") for c in plan.columns])
    size = word_count(F.col("text"))
    key = _key(seed)
    extra = F.when(key < F.col("__cut_key"), size).when(key == F.col("__cut_key"), F.col("__part")).otherwise(F.lit(0))
    joined = base.withColumn("size", size).join(_small(plan, plan), F.col("source").eqNullSafe(F.col("__source")))
    return joined.select(
        *base.columns,
        "size",
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__whole") * F.col("size") + extra).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, seed: int = 42, **rule) -> DataFrame:
    """The mix itself: each document as often as it is taken, columns as before.

    A document without words is in the mix once. The part of the document at a cut is its first
    words joined by blanks; ``n_chars`` follows the text.
    """
    columns = [c for c in docs.columns if c not in OUT]
    mixed = mix(docs, seed, **rule)
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int")
    rest = F.col("taken") - F.col("__copy") * F.col("size")
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), F.lit(1), F.col("__rest").cast("int")), " ")
    whole = (F.col("size") == 0) | (F.col("__rest") >= F.col("size"))
    return (
        mixed.filter(copies > 0)
        .withColumn("__copy", F.explode(F.sequence(F.lit(0), copies - 1)))
        .withColumn("__rest", rest)
        .select(
            *[
                F.when(whole, F.col("text")).otherwise(head).alias("text")
                if c == "text"
                else F.when(whole, F.col(c)).otherwise(F.length(head)).cast("long").alias(c)
                if c == "n_chars"
                else F.col(c)
                for c in columns
            ]
        )
    )
