"""The corpus pipeline: quality, near-duplicates, secrets, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; ``run`` writes each
stage as Parquet to the shared folder and reads it back as the next one's documents. The files go when the driver ends.

Defined cases: null and empty texts fail the base rules and go in the first stage (a later stage on its own treats a null as an
empty text); rows with a null id take part by their text; very long texts are processed whole, one at a time in a task;
repeated rows leave one copy in the second stage; an empty table stays empty; columns other than doc_id, text, lang and
source are handed on by the first four stages, whatever their names, ``n_chars`` follows the text.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import divergence, mixing, novelty, pieces, vptree
from barloom.session import delete_at_end, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Rows that a Python worker holds at once: texts are long, and the workers of several stages share an executor.
BATCH_ROWS = 1_000


def _in_batches(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@_in_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and stay near their language's distribution."""
    return divergence.kept_documents(docs)


@_in_batches
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of texts at 5-word similarity 0.8 or more."""
    return vptree.one_of_similar(docs)


@_in_batches
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return novelty.redacted(docs)


@_in_batches
def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    # Columns that are named like results of the mixture keep out of its way.
    own = {c: f"__own_{c}" for c in docs.columns if c in mixing.OUT}
    mixed = mixing.mixed_documents(docs.withColumnsRenamed(own))
    return mixed.withColumnsRenamed({hidden: c for c, hidden in own.items()})


@_in_batches
def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document of the mixture."""
    return pieces.sampled_segmentations(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

#: The divergence, SimHash, zstandard and Gumbel stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4()}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    delete_at_end(spark, folder)
    return docs
