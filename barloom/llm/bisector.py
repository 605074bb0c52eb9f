"""Centroid clustering by a bisector tournament, in whole numbers.

Vectors become integers floor(1024 x). The centroids are few (k of d numbers), so the driver precomputes for each
pair i < j the normal 2 (c_j - c_i) and the threshold |c_j|^2 - |c_i|^2 of the bisecting plane: a vector is
nearer to j only if its product with the normal exceeds the threshold. A vector meets the centroids in order, k - 1 tests in
all; the loser of a test is out, zero keeps the smaller number. Only the distance to the winner is computed.

Each round is one pass over the table: a task adds up counts and components per centroid and sends at most
k (d + 2) numbers, in limbs of 48 bits, which Spark sums up exactly; k centroids come back to the driver. A task
that is run again gives the same numbers. The table is read once a round: hand over a stored one.

Numbers are 64 bits wide if the values allow it and Python integers else, so every result is exact; a distance
or inertia beyond 63 bits is null.

Defined cases: vectors of another length, with a null or a non-finite component are left out; fewer kept vectors than k give as
many centroids; equal vectors and ties go to the smaller centroid; repeated rows count each; starts of equal hash (equal ids) go
by their components, a null id starts last; a centroid without vectors stays where it is; empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024
#: Components below this bound keep every product of 64 components within 63 bits.
SMALL = 1 << 26
LIMB = 48
LONGEST = (1 << 63) - 1


def integers(values: np.ndarray) -> np.ndarray:
    """floor(1024 x) of finite doubles, as 64-bit integers if they are small, as Python integers else."""
    if not values.size or np.abs(values).max() < SMALL / SCALE:
        return np.floor(values * SCALE).astype(np.int64)
    exact = [SCALE * int(x) if abs(x) >= 2.0**53 else math.floor(SCALE * x) for x in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


@dataclass(frozen=True)
class Bisectors:
    """Centroids with the planes between each two of them."""

    centroids: list[list[int]]

    def planes(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = np.array(self.centroids, object)
        square = (c * c).sum(axis=1)
        normals, thresholds = 2 * (c[None, :, :] - c[:, None, :]), square[None, :] - square[:, None]
        return c.astype(kind), normals.astype(kind), thresholds.astype(kind)

    def small(self) -> bool:
        return max((abs(v) for c in self.centroids for v in c), default=0) <= SMALL and len(self.centroids[0]) <= 64

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of, and squared distance to, the nearest centroid of each row."""
        kind = np.int64 if vectors.dtype == np.int64 and self.small() else object
        vectors = vectors.astype(kind, copy=False)
        c, normals, thresholds = self.planes(kind)
        best = np.zeros(len(vectors), np.int64)
        for j in range(1, len(c)):
            side = (vectors * normals[best, j]).sum(axis=1) - thresholds[best, j]
            best[np.asarray(side > 0, bool)] = j
        away = vectors - c[best]
        return best, (away * away).sum(axis=1)


def _kept(vector: Column, dims: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(vector) == dims) & ~bad


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return integers(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(position, signed limb) of the limbs of ``value`` that are not zero."""
    sign, rest, at = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        if part := rest & ((1 << LIMB) - 1):
            yield at, sign * part
        rest >>= LIMB
        at += 1


def _totals(vectors: DataFrame, planes: Bisectors, dims: int) -> dict[int, list[int]]:
    """For each centroid with vectors: their count, their distances, the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            rows = _matrix(batch.column("vector"), dims)
            if not len(rows):
                continue
            best, distance = planes.nearest(rows)
            for c in np.unique(best).tolist():
                own = best == c
                # Sums of a batch in 64 bits: at most 2^20 rows of less than 2^26; distances may be wider.
                part = rows[own] if len(rows) <= 1 << 20 else rows[own].astype(object)
                new = [int(own.sum()), sum(distance[own].tolist()), *map(int, part.sum(axis=0))]
                sums[c] = [a + b for a, b in zip(sums[c], new, strict=True)] if c in sums else new
        out = [(c, i, at, limb) for c, total in sums.items() for i, v in enumerate(total) for at, limb in _limbs(v)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["cluster", "item", "limb", "part"])

    parts = vectors.select("vector").mapInArrow(run, "cluster int, item int, limb int, part long")
    totals: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "item", "limb").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("part")).collect():
        own = totals.setdefault(r["cluster"], [0] * (dims + 2))
        own[r["item"]] += int(r["part"]) << (LIMB * r["limb"])
    return totals


def _long(value: int) -> int | None:
    return value if value <= LONGEST else None


OUT = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of each kept vector.

    Centroids start as the vectors with the k smallest sha256 of ``seed:key``.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(_kept(F.col("vector"), dims))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    starts = rows.orderBy(order.asc_nulls_last(), "vector").limit(k).collect()
    schema = f"{key} long, {OUT}"
    if not starts:
        return spark.createDataFrame([], schema)
    centroids = [list(map(int, c)) for c in integers(np.array([r["vector"] for r in starts], np.float64))]
    for _ in range(rounds):
        for c, (count, _, *sums) in _totals(rows, Bisectors(centroids), dims).items():
            centroids[c] = [s // count for s in sums]
    planes = Bisectors(centroids)
    inertia = {c: total[1] for c, total in _totals(rows, planes, dims).items()}
    whole = _long(sum(inertia.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance = planes.nearest(_matrix(batch.column("vector"), dims))
            best = best.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array(best, pa.int32()),
                    pa.array([_long(d) for d in distance.tolist()], pa.int64()),
                    pa.array([_long(inertia[c]) for c in best], pa.int64()),
                    pa.array([whole] * len(best), pa.int64()),
                    pa.array([digests[c] for c in best], pa.string()),
                ],
                names=[key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return rows.mapInArrow(run, schema)
