"""Order MinHash fingerprints, sensitive to edit distance.

Each k-mer of a text (``K`` characters at every position) gets the number of its earlier occurrences, so
repeats count. The hash of (k-mer, occurrence) puts it into one of ``SLOTS`` slots and gives its rank
there: one pass serves all slots, where separate hash functions would need a pass each. A slot takes its
``TUPLE`` minimal k-mers, or the next ones in order of slot and rank if it has too few; they are put
back into text order and the tuple is hashed. Two fingerprints are alike in the share of slots that agree:
moving a passage changes tuples although the set of k-mers stays.

``with_next`` pairs each document with the next by doc_id without a global sort in one task: ranges of
ids are cut at quantiles, each range is sorted in its task, and the first document of a range is
sent to the range before as well (of the first range: to the last). Texts move once.

Defined cases: null text is empty and its fingerprint is zero in every slot; a text shorter than a k-mer is one
k-mer; a single document is its own next; rows with equal ids follow each other by hash of their text; null
ids come first; empty tables give empty results; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import GOLDEN, mix64

K = 6
SLOTS = 64
TUPLE = 2
BASE = np.uint64(0x100000001B3)
#: Documents in a range of ids, about, and the most ranges (their bounds are on the driver).
RANGE_ROWS = 2_048
MOST_RANGES = 8_192
LOWEST = -(1 << 63)


def order_minhash(text: str) -> np.ndarray:
    """One 16-bit hash per slot."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(points):
        return np.zeros(SLOTS, np.uint16)
    k = min(K, len(points))
    n = len(points) - k + 1
    kmers = np.zeros(n, np.uint64)
    for i in range(k):
        kmers = kmers * BASE + points[i : i + n] + np.uint64(1)
    kmers = mix64(kmers)
    # Sorted by k-mer, then position: the low bits carry the position.
    bits = np.uint64(24 if n < 1 << 24 else 32)
    low = (np.uint64(1) << bits) - np.uint64(1)
    places = np.arange(n, dtype=np.uint64)
    packed = np.sort((kmers >> bits << bits) | places)
    new = np.concatenate(([True], (packed[1:] ^ packed[:-1]) > low))
    rows = np.arange(n)
    occurrence = (rows - np.maximum.accumulate(np.where(new, rows, 0))).astype(np.uint64)
    at = packed & low
    ranked = mix64(kmers[at] + occurrence * GOLDEN)
    ranked = np.sort((ranked >> bits << bits) | at)
    slot_bits = np.uint64(64 - SLOTS.bit_length() + 1)
    first = np.searchsorted(ranked, np.arange(SLOTS, dtype=np.uint64) << slot_bits)
    chosen = ranked[(first[:, None] + np.arange(TUPLE)) % n] & low
    ordered = kmers[np.sort(chosen, axis=1)]
    out = np.zeros(SLOTS, np.uint64)
    for i in range(TUPLE):
        out = mix64(out * BASE + ordered[:, i])
    return (out >> np.uint64(48)).astype(np.uint16)


def shown(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited_text(text: str, following: str) -> str:
    """The last quarter of the text replaced by as much of the start of the following one."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, range, lent: sorted in each partition so that the next row of a range is the next document.

    Rows with ``lent`` end a range and only serve as the next document of the last one.
    """
    order = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("at", F.coalesce("doc_id", F.lit(LOWEST)))
    ids = order.select(F.col("at").cast("double").alias("at"))
    ranges = max(1, min(MOST_RANGES, ids.count() // RANGE_ROWS))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(ids.approxQuantile("at", shares, 0.2 / ranges))) if shares else []
    splits = [-float("inf"), *cuts, float("inf")]

    def ranged(df: DataFrame) -> DataFrame:
        if not cuts:
            return df.withColumn("range", F.lit(0))
        df = df.withColumn("as_double", F.col("at").cast("double"))
        return Bucketizer(splits=splits, inputCol="as_double", outputCol="range").transform(df).drop("as_double").withColumn("range", F.col("range").cast("int"))

    firsts = [(r["range"], r["first"]) for r in ranged(order.select("at")).groupBy("range").agg(F.min("at").alias("first")).orderBy("range").collect()]
    lend = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    lent = docs.sparkSession.createDataFrame(lend, "at long, to int")  # a row per range: MOST_RANGES at most
    both = ranged(order).join(F.broadcast(lent), "at", "left")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("lent"))
    other = F.struct(F.col("to").alias("range"), F.lit(True).alias("lent"))
    spread = both.select("doc_id", "at", "text", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, other))).alias("e"))
    rows = spread.select("doc_id", "at", "text", "e.range", "e.lent", F.xxhash64("text").alias("h"))
    return rows.repartition(max(1, len(firsts)), "range").sortWithinPartitions("range", "lent", "at", "h").select("doc_id", "text", "range", "lent")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness to it and to the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (range, doc_id, text, fingerprint) that waits for its next document
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        for batch in batches:
            out = []
            for doc, text, part, lent in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if lent and (held is None or held[0] != part):
                    continue  # another row has served already
                text = text or ""
                mine = order_minhash(text)
                if held is not None and held[0] == part:
                    _, before, old, print_ = held
                    changed = edited_text(old, text)
                    other = order_minhash(changed)
                    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((before, len(old), sha, shown(print_), shown(other), likeness(print_, other), likeness(print_, mine)))
                held = None if lent else (part, doc, text, mine)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))

    return with_next(docs).mapInArrow(run, SCHEMA)
