"""What several operators share: words, hashes inside tasks, Arrow passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but blank, tab, LF, VT, FF, CR. On bytes that is ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray) -> np.ndarray:
    """Doubles in the open interval (0, 1), one per 64-bit key."""
    return ((mix64(key) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def word_count(text) -> object:
    """Number of words of a string column, null counting as no text; JVM-side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: A key with more than 1 / HOT of the rows is hot.
HOT = 4096


def matched(rows: DataFrame, one: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` (stored) joined with ``one`` (stored, a row per key with ``n``, its number of ``rows``).

    Hot keys, of which there are at most ``HOT``, are broadcast, so that no task gets all rows of one.
    """
    hot = F.col("n") * HOT > rows.count()
    few = F.broadcast(one.filter(hot).drop("n"))
    cold = rows.join(few.select(*on), on, "left_anti").join(one.filter(~hot).drop("n"), on)
    return cold.unionByName(rows.join(few, on))


def arrow_map(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Map record batches to record batches: ``fn`` takes and gives a dict of columns (lists, arrays).

    Lists of ``None``-able Python values or numpy and Arrow arrays may be given back; types
    come from ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = df.columns
    target = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(target)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = fn({name: batch.column(i) for i, name in enumerate(names)})
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) if isinstance(c := out[f.name], pa.Array) else pa.array(c, type=f.type) for f in arrow],
                schema=arrow,
            )

    return df.mapInArrow(run, target)
