"""Configuration grids, their results and the verdicts drawn from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The pre-registered sweep grid and its exclusions
# (swing, take profit, stop, timeframe) with mostly neutral labels.
SWINGS = (5, 7, 10, 15, 20)
TP_SL_PAIRS = ((1.0, 1.0), (1.5, 1.0), (1.5, 1.5), (2.0, 1.0), (2.0, 1.5), (2.0, 2.0))
SWEEP_TIMEFRAMES = ("4h", "1h")
EXCLUDED = (
    (5, 2.0, 1.5, "4h"), (5, 2.0, 1.5, "1h"), (5, 2.0, 2.0, "4h"), (5, 2.0, 2.0, "1h"),
    (7, 2.0, 2.0, "4h"), (7, 2.0, 2.0, "1h"), (5, 1.5, 1.5, "1h"),
)
SLOT = "swing int, tp double, sl double, timeframe string"
SLOT_KEYS = ("swing", "tp", "sl", "timeframe")

# Barriers and swings of the production search grid.
PRODUCTION_TP = (1.0, 1.5, 2.0, 3.0)
PRODUCTION_SL = (1.0, 1.5, 2.0, 2.5)
PRODUCTION_SWINGS = (5, 7, 10)


def sweep_slots(spark: SparkSession) -> DataFrame:
    """The 53 valid settings: every swing, pair and timeframe but the exclusions."""
    pairs = spark.createDataFrame(list(TP_SL_PAIRS), "tp double, sl double")
    slots = fan_out(fan_out(pairs, F.lit(list(SWINGS)), "swing"), F.lit(list(SWEEP_TIMEFRAMES)), "timeframe")
    return slots.select(*SLOT_KEYS).join(spark.createDataFrame(list(EXCLUDED), SLOT), list(SLOT_KEYS), "left_anti")


def fan_out(df: DataFrame, options: Column, name: str) -> DataFrame:
    """One copy of each row per element of a short literal array."""
    return df.withColumn(name, F.explode(options))


def best_swing(results: DataFrame, keys: Sequence[str], min_trades: int = 20, default: int = 10) -> DataFrame:
    """Swing with the best mean delta among those with enough trades on both blocks."""
    enough = (F.col("val_trades") >= min_trades) & (F.col("test_trades") >= min_trades)
    mean = (F.col("delta_val") + F.col("delta_test")) / 2
    order = F.when(enough, F.struct(F.round(mean, 12), -F.col("swing")))
    return results.groupBy(*list(keys)).agg(F.coalesce(F.max_by("swing", order), F.lit(default)).alias("best_swing"))


def ab_compare(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Treatment against control per key: differences and whether the gate flips."""
    keys = list(keys)

    def side(name: str, column: str) -> Column:
        return F.max(F.when(F.col("variant") == name, F.col(column)))

    wide = runs.groupBy(*keys).agg(
        *[side(v, c).alias(f"{v.lower()}_{c}") for v in ("CONTROL", "TREATMENT") for c in ("p5", "p95", "pooled_trades", "passes_gate")]
    )
    control, treatment = F.col("control_passes_gate"), F.col("treatment_passes_gate")
    return wide.select(
        *keys,
        (F.col("treatment_p5") - F.col("control_p5")).alias("delta_p5"),
        (F.col("treatment_p95") - F.col("control_p95")).alias("delta_p95"),
        (F.col("treatment_pooled_trades") - F.col("control_pooled_trades")).alias("delta_trades"),
        F.when(~control & treatment, "to_pass").when(control & ~treatment, "to_fail").otherwise("none").alias("gate_flip"),
    )


def rigor_check(runs: DataFrame, keys: Sequence[str] = ("symbol", "timeframe"), max_ci_width: float | None = None) -> DataFrame:
    """A raw pass counts only if every formulation and every seed agrees."""
    positive = F.coalesce(F.col("p5") > 0, F.lit(False))
    width = F.max(F.col("p95") - F.col("p5"))
    narrow = F.lit(True) if max_ci_width is None else width <= max_ci_width
    return runs.groupBy(*list(keys)).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if("passes_gate").alias("n_pass"),
        F.bool_and(positive).alias("all_positive"),
        width.alias("max_ci_width"),
        (F.bool_and(positive) & F.bool_or("passes_gate") & F.coalesce(narrow, F.lit(False))).alias("rigorous"),
    )


def asset_verdict(runs: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Reject without a pass; conditional for one or two passes that share a timeframe
    or a formulation; else approve."""
    passed = F.col("passes_gate")
    sums = runs.groupBy(*list(keys)).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(passed).alias("n_pass"),
        F.count_distinct(F.when(passed, F.col("timeframe"))).alias("_tf"),
        F.count_distinct(F.when(passed, F.col("formulation"))).alias("_form"),
    )
    narrow = (F.col("n_pass") <= 2) & ((F.col("_tf") == 1) | (F.col("_form") == 1))
    verdict = F.when(F.col("n_pass") == 0, "reject").when(narrow, "conditional").otherwise("approve")
    return sums.select(*list(keys), "n_runs", "n_pass", verdict.alias("verdict"))


def feature_verdict(runs: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Fate of a treatment feature by its number of passes."""
    sums = runs.groupBy(*list(keys)).agg(F.count(F.lit(1)).alias("n_runs"), F.count_if("passes_gate").alias("n_pass"))
    verdict = F.when(F.col("n_pass") == 0, "failed").when(F.col("n_pass") <= 2, "suspicious").otherwise("successful")
    return sums.withColumn("verdict", verdict)
