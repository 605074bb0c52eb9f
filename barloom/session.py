"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("barloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call-site capture costs a driver round trip per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only a local session without one (tests, a laptop) gets a folder of its own, named after the
    application, in the temporary folder; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{tempfile.gettempdir()}/barloom-{context.applicationId}"


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Let the file system delete ``path`` when the driver ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


#: Spark deletes the shuffle files of an execution when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, compression: str = "snappy", shuffles: bool = True) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: compact, for tables that are read again.

    The files go when the driver ends. Without ``shuffles`` the shuffle files of ``df`` go at once.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    before = df.sparkSession.conf.get(SHUFFLES_GO, None)
    if not shuffles:
        df.sparkSession.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if not shuffles:
            df.sparkSession.conf.unset(SHUFFLES_GO) if before is None else df.sparkSession.conf.set(SHUFFLES_GO, before)
    delete_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as a reliable checkpoint and read it back.

    It survives the loss of executors. With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes
    the files once the result is no longer referenced.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
