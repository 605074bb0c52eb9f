"""Readers and writers of bar tables, external series, reports and result logs.

Bars lie in ``symbol=/timeframe=`` directories, so a filter on the series prunes
directories and one on ``ts`` reaches the file statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom import schemas
from barloom.functions.keys import bar_open, canonical_symbol

TOP_SALTS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV bars under ``symbol=<s>/timeframe=<t>/``; daily and coarser open at midnight."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"no bars at {path}: land them with write_bars or as CSV under symbol=/timeframe=")
    raw = (
        spark.read.schema(T.StructType([*schemas.BAR_FILE.fields, *schemas.BAR.fields[:2]]))
        .option("header", True)
        .csv(path)
    )
    opened = raw.withColumn("ts", bar_open(F.col("timestamp"), F.col("timeframe")))
    return opened.select([f.name for f in schemas.BAR.fields])


def read_bars(spark: SparkSession, path: str, schema: T.StructType = schemas.MICRO_BAR) -> DataFrame:
    if not _exists(spark, path):
        raise FileNotFoundError(f"no bars at {path}: land them with write_bars")
    return spark.read.schema(schema).parquet(path)


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned parquet. A series is split over writers by month, so a hot one
    neither lands in one task nor leaves one file per writer and directory."""
    out = bars.withColumn("symbol", canonical_symbol(F.col("symbol")))
    spread = out.repartition("symbol", "timeframe", F.date_trunc("month", "ts"))
    spread.sortWithinPartitions("symbol", "timeframe", "ts").write.mode(mode).partitionBy("symbol", "timeframe").parquet(path)


def read_series(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """An external series; an empty table when nothing has landed yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def latest_bars(bars: DataFrame, n: int = 100, keys: Sequence[str] = schemas.SERIES_KEYS) -> DataFrame:
    """The ``n`` newest bars of every series.

    Top ``n`` per salt first, then of the survivors: a hot series is ranked in
    ``TOP_SALTS`` parts and at most ``n`` rows of each part meet in one task.
    """
    keys = list(keys)
    salted = bars.withColumn("_salt", F.pmod(F.xxhash64("ts"), F.lit(TOP_SALTS)))
    part = Window.partitionBy(*keys, "_salt").orderBy(F.desc("ts"))
    whole = Window.partitionBy(*keys).orderBy(F.desc("ts"))
    return (
        salted.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= n)
        .withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= n)
        .drop("_r", "_salt")
    )


def latest_bar(bars: DataFrame, keys: Sequence[str] = schemas.SERIES_KEYS) -> DataFrame:
    """The newest bar of every series: one map-side combinable aggregate, no sort."""
    keys = list(keys)
    rest = [c for c in bars.columns if c not in keys]
    last = bars.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ts").alias("_last"))
    return last.select(*keys, "_last.*").select(*bars.columns)


def date_range(df: DataFrame, start: str, end: str, closed: bool = False) -> DataFrame:
    """Bars of ``[start, end)``, or ``[start, end]`` when ``closed``; pushed to the scan."""
    ts = F.col("ts")
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    return df.filter((ts >= lo) & ((ts <= hi) if closed else (ts < hi)))


def write_report(rows: DataFrame, path: str, experiment: str, stamp: str) -> None:
    """One JSON document set per stamp; ``latest_report`` finds the newest."""
    rows.withColumns({"experiment": F.lit(experiment), "stamp": F.lit(stamp)}).write.mode("append").partitionBy(
        "experiment", "stamp"
    ).json(path)


def latest_report(spark: SparkSession, path: str, experiment: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("experiment", T.StringType()), T.StructField("stamp", T.StringType())])
    runs = spark.read.schema(full).json(path).filter(F.col("experiment") == experiment)
    return runs.filter(F.col("stamp") == runs.agg(F.max("stamp")).scalar())


def write_csv_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_runs(rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Results of runs, one directory per run key: writing a run again replaces it, so a repeated job leaves one copy."""
    spread = rows.repartition(*[F.col(k) for k in keys])
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_runs(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What ``write_runs`` left; an empty table before the first run."""
    return read_series(spark, path, schema)


def pending(configs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Configurations without a result yet."""
    return configs.join(done.select(*list(keys)), list(keys), "left_anti")
