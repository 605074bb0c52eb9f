"""The daily signal scan as an incremental stream.

New closed bars arrive as files; every micro-batch is appended to the bar table and
only the series that got a bar are scored again, on their full history (so running
indicators agree with the training history).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from barloom.operators.asof import keep_last
from barloom.plans.jobs import latest_signals
from barloom.schemas import BAR, SERIES_KEYS
from pyspark.sql import functions as F


def closed_bars(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of landed parquet bars."""
    return spark.readStream.schema(BAR).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def scan_stream(
    stream: DataFrame,
    table_path: str,
    signals_path: str,
    models: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    checkpoint: str,
) -> StreamingQuery:
    """Append bars to ``table_path`` and signals of the newest bars to ``signals_path``.

    ``scorer`` turns bars into bars with ``atr_14`` and ``score``. Both tables carry the
    batch number; a replayed batch overwrites its own partition, so a restart after
    the loss of a driver neither loses nor repeats bars.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        replace = {"mode": "overwrite"}
        batch.write.parquet(f"{table_path}/batch={batch_id}", **replace)
        history = spark.read.schema(BAR).parquet(table_path)
        # Batches count as numbers: as text, 9 would come after 10. Inside a batch, the later row wins.
        landed = F.struct(F.col("batch").cast("long"), "_metadata.file_path", "_metadata.row_index")
        touched = batch.select(*SERIES_KEYS).distinct()
        affected = history.select(*BAR.names, landed.alias("_from")).join(touched, list(SERIES_KEYS), "left_semi")
        bars = keep_last(affected, [*SERIES_KEYS, "ts"], "_from").drop("_from")
        latest_signals(scorer(bars), models).write.parquet(f"{signals_path}/batch={batch_id}", **replace)

    return (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
