"""Exact quantiles of skewed groups.

The built-in exact percentile keeps all distinct values of a group in one task. Here a rank is
bracketed first: the approximate percentile has a proven rank error, so two of them, a little below and
above, enclose the exact rank whatever the distribution, outliers and constants included. Rows below a
bracket are only counted; rows inside it are few, are counted by value, and only
their distinct values are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The approximate percentile errs by at most a share of 1 / ACCURACY of the rows.
ACCURACY = 100_000


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], accuracy: int = ACCURACY
) -> DataFrame:
    """Linearly interpolated quantiles per key: one column per entry of ``probs``."""
    keys, points = list(keys), [float(p) for p in probs.values()]
    rows = df.select(*keys, F.col(value).alias("_v")).filter("_v IS NOT NULL")
    away = 3.0 / accuracy
    around = [min(1.0, max(0.0, p + side)) for p in points for side in (-away, away)]
    ends = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        F.percentile_approx("_v", around, accuracy).alias("_c"),
    )
    brackets = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                (F.col("_lo") if p - away <= 0 else F.col("_c")[2 * i]).alias("a"),
                (F.col("_hi") if p + away >= 1 else F.col("_c")[2 * i + 1]).alias("b"),
            )
            for i, p in enumerate(points)
        ]
    )
    placed = rows.join(ends.select(*keys, brackets.alias("_r")), keys)
    v, r = F.col("_v"), F.col("_r")
    sides = placed.groupBy(*keys).agg(
        *[
            F.struct(
                F.count_if(v < r[i]["a"]).alias("below"),
                F.count_if((v >= r[i]["a"]) & (v <= r[i]["b"])).alias("inside"),
                F.max(F.when(v < r[i]["a"], v)).alias("under"),
                F.min(F.when(v > r[i]["b"], v)).alias("above"),
            ).alias(f"_{i}")
            for i in range(len(points))
        ]
    )
    sides = sides.select(*keys, F.posexplode(F.array(*[F.col(f"_{i}") for i in range(len(points))])).alias("_i", "_s"))
    sides = sides.select(*keys, "_i", "_s.*")
    inside = placed.select(
        *keys, "_v", F.explode(F.filter("_r", lambda b: (v >= b["a"]) & (v <= b["b"]))).alias("_b")
    ).select(*keys, F.col("_b.i").alias("_i"), "_v")
    counts = inside.groupBy(*keys, "_i", "_v").agg(F.count(F.lit(1)).alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*keys, "_i").orderBy("_v"))
    last = F.col("below") + upto - 1
    held = counts.join(sides, [*keys, "_i"]).select(*keys, "_i", "_v", (last - F.col("_k") + 1).alias("_first"), last.alias("_last"))
    # In a small group the other rank of an interpolation may be the next value outside.
    edges = F.array(
        F.struct(F.col("under").alias("v"), (F.col("below") - 1).alias("at")),
        F.struct(F.col("above").alias("v"), (F.col("below") + F.col("inside")).alias("at")),
    )
    outside = sides.select(*keys, "_i", F.explode(edges).alias("_e")).filter("_e.v IS NOT NULL")
    outside = outside.select(*keys, "_i", F.col("_e.v").alias("_v"), F.col("_e.at").alias("_first"), F.col("_e.at").alias("_last"))
    ranked = held.unionByName(outside).join(ends.select(*keys, "_n"), keys)
    # The value holds ranks [first, last]; a quantile is a weighted sum of the ranks around its place.
    first, last = F.col("_first"), F.col("_last")
    at = F.lit(points)[F.col("_i")] * (F.col("_n") - 1)
    low = F.floor(at)
    share = at - low
    weight = F.when((low >= first) & (low <= last), 1.0 - share).otherwise(0.0) + F.when(
        (low + 1 >= first) & (low + 1 <= last), share
    ).otherwise(0.0)
    hits = ranked.withColumn("_w", weight).filter("_w > 0")
    return hits.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("_i") == i, F.col("_v") * F.col("_w"))).alias(name) for i, name in enumerate(probs)]
    )
