"""Backward as-of joins, leakage-safe by construction.

Every call names its ``availability_lag``: the time that passes between the key
of a right-hand row and the moment its value may be used.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.keys import epoch_micros

BUCKET = timedelta(days=28)  # default slice of time sorted by one task
SALTS = 32  # tasks per slice when no key spreads the left rows
DAY = timedelta(days=1)


def keep_last(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """One row per key: the one with the highest ``seq``.

    ``max_by`` combines on the map side, so many copies of one key do not meet in
    one task unreduced.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_last"))
    return last.select(*keys, "_last.*").select(*df.columns)


def _shift(ts: Column, lag: timedelta) -> Column:
    return ts + F.expr(f"INTERVAL '{int(lag.total_seconds())}' SECOND")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    availability_lag: timedelta,
    by: Sequence[str] = (),
    ts: str = "ts",
    bucket: timedelta = BUCKET,
) -> DataFrame:
    """For each left row the latest right row with ``ts + lag <= left.ts``.

    ``right`` holds one row per ``(by, ts)`` (see ``keep_last``). A matched row whose
    value is NULL stays NULL, as with an as-of join in SQL.

    Both sides go through one sort per ``(by, time bucket)``; the last right row of
    the earlier buckets comes from a table with one row per bucket. A hot ``by`` key
    is thus spread over its buckets. Without ``by`` the left rows are spread by a salt and
    the right side, a single global series, is copied to every salt.
    """
    by = list(by)
    if not by:
        salted = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
        copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return asof_join(salted, copies, values, availability_lag, ["_salt"], ts, bucket).drop("_salt")
    span = int(bucket.total_seconds()) * 1_000_000
    payload = F.struct(*values)
    shape = left.columns

    def slotted(df: DataFrame, instant: Column) -> DataFrame:
        return df.withColumn("_slot", F.floor(F.try_divide(epoch_micros(instant), F.lit(span))).cast("long"))

    events = slotted(right.withColumn("_at", _shift(F.col(ts), availability_lag)), F.col("_at")).select(
        *by, "_slot", F.col("_at"), F.lit(0).alias("_side"), payload.alias("_value"),
        F.lit(None).cast(left.select(F.struct(*shape)).schema[0].dataType).alias("_row"),
    )
    rows = slotted(left, F.col(ts)).select(
        *by, "_slot", F.col(ts).alias("_at"), F.lit(1).alias("_side"),
        F.lit(None).cast(events.schema["_value"].dataType).alias("_value"), F.struct(*shape).alias("_row"),
    )
    both = events.unionByName(rows)

    # Last value known before each slot that occurs on either side.
    ends = (
        events.groupBy(*by, "_slot").agg(F.max_by("_value", "_at").alias("_end"))
        .unionByName(
            slotted(left, F.col(ts)).groupBy(*by, "_slot").agg(F.count(F.lit(1)).alias("_n"))
            .select(*by, "_slot", F.lit(None).cast(events.schema["_value"].dataType).alias("_end"))
        )
        .groupBy(*by, "_slot").agg(F.first("_end", ignorenulls=True).alias("_end"))
    )
    before = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*by, "_slot", F.last("_end", ignorenulls=True).over(before).alias("_carry"))

    local = Window.partitionBy(*by, "_slot").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn("_known", F.last("_value", ignorenulls=True).over(local))
        .filter("_side = 1")
        .join(carry, [*by, "_slot"])
        .select("_row.*", F.coalesce("_known", "_carry").alias("_known"))
        .select(*shape, *[F.col(f"_known.{v}").alias(v) for v in values])
    )


def asof_daily(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    availability_lag: timedelta,
    by: Sequence[str] = (),
    ts: str = "ts",
) -> DataFrame:
    """``asof_join`` for a midnight-aligned right side: an equi-join on the day.

    The right side (one row per ``(by, day)``) becomes a dense, forward-filled
    calendar. Without ``by`` that is one row per day, 3.7 million rows for the whole
    range of DATE and some ten thousand in practice, so it is broadcast and the bars
    are not shuffled at all. With ``by`` the day is part of the join key, which
    spreads a hot key over its days. Requires a lag of whole days; a right row off midnight is
    an error (its value would be used before it exists), and of several rows of one day and key the
    greatest counts.
    """
    if availability_lag % DAY:
        raise ValueError("a daily as-of join needs a lag of whole days")
    by = list(by)
    day = F.to_date(F.col(ts))
    midnight = F.when(F.date_trunc("day", ts).cast(right.schema[ts].dataType) == F.col(ts), day).otherwise(
        F.raise_error(F.concat(F.lit("a daily as-of join needs midnights on the right side, found "), F.col(ts).cast("string"))).cast("date")
    )
    daily = (
        right.filter(F.col(ts).isNotNull())
        .select(*by, F.date_add(midnight, availability_lag.days).alias("_day"), F.struct(*values).alias("_known"))
        .groupBy(*by, "_day")
        .agg(F.max("_known").alias("_known"))
    )
    # A value holds until the day before the next one of its key.
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_day")
    until = F.date_sub(F.lead("_day").over(order), 1)
    keyed = left.withColumn("_day", day)
    if by:
        # The last value of a key holds until the last day of the left side.
        until = F.coalesce(until, F.greatest(left.agg(F.max(day)).scalar(), F.col("_day")))
        known = F.col("_known")
    else:
        # Later rows read the last value directly: one row, no pass over the left side.
        newest = daily.agg(F.max_by(F.struct("_day", "_known"), "_day")).scalar()
        until = F.coalesce(until, F.col("_day"))
        known = F.coalesce("_known", F.when(F.col("_day") > newest["_day"], newest["_known"]))
    spans = daily.withColumn("_until", until)
    calendar = spans.select(*by, F.explode(F.sequence("_day", "_until")).alias("_day"), "_known")
    return (
        keyed.join(calendar if by else F.broadcast(calendar), [*by, "_day"], "left")
        .withColumn("_known", known)
        .select(*left.columns, *[F.col(f"_known.{v}").alias(v) for v in values])
    )
