"""Periodic runs of words: Lyndon roots extended by suffix-tree LCE.

A run is a maximal stretch of words with smallest period q and a length of at least ``min_length`` and
``min_exponent`` times q. Each document is one task-local problem:

1. Ukkonen's algorithm builds the suffix trees of the document and of its reversal. A tour of a tree visits
   its leaves in suffix order; the least depth met between two leaves is the depth of their lowest common
   ancestor, the length of the longest common extension (LCE) of their suffixes. The tour keeps one
   depth per gap between leaves, a sparse table answers a range minimum in constant time.
2. The suffix order gives each position its longest Lyndon word in the order of the words and in the reversed
   order: it ends at the next smaller, or the next greater suffix. Each run of exponent 2 or more has
   a root among these 2n candidates.
3. Each candidate is extended to the right by the first tree and to the left by the second; what is
   long enough is a run. A Lyndon word is primitive, so its length is the smallest period.

Before the trees, stretches that cannot hold a run are replaced by one word that occurs nowhere else: in a run
with ``min_exponent`` 4 each 3-gram occurs three times in the document (``least_grams``), so a stretch between rarer 3-grams
holds none. This is exact for every setting and makes the trees as long as the repetitive part of the text.

Defined cases: null or empty text has no words and no runs; repeated rows get equal results; a null id is an id like
others; empty tables give empty results; columns other than the named text column are handed on, but
those named ``n_words``, ``runs`` or ``collapsed``, which are replaced. Memory of a task grows with its longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MIN_LENGTH = 6
MIN_EXPONENT = 4


def suffix_tree(s: list[int]) -> tuple[list[int], list[int], list[dict[int, int]]]:
    """Ukkonen's tree of ``s``, whose last symbol is unique: start and end of each node's edge, children by first symbol."""
    n = len(s)
    start, end, link, down = [0], [0], [0], [{}]
    node = edge = length = pending = 0
    for pos in range(n):
        symbol = s[pos]
        pending += 1
        last = 0
        while pending:
            if not length:
                edge = pos
            first = s[edge]
            child = down[node].get(first)
            if child is None:
                down[node][first] = len(start)
                start.append(pos)
                end.append(n)
                link.append(0)
                down.append(None)
                if last:
                    link[last] = node
                    last = 0
            else:
                at = start[child]
                span = end[child] - at
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                if s[at + length] == symbol:
                    length += 1
                    if last:
                        link[last] = node
                    break
                split, leaf = len(start), len(start) + 1
                start += (at, pos)
                end += (at + length, n)
                link += (0, 0)
                down += ({symbol: leaf, s[at + length]: child}, None)
                start[child] = at + length
                down[node][first] = split
                if last:
                    link[last] = split
                last = split
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = pos - pending + 1
    return start, end, down


class Extensions:
    """Longest common extensions of suffixes in constant time."""

    def __init__(self, s: list[int]) -> None:
        start, end, down = suffix_tree(s)
        leaves, gaps = [], []
        after_leaf = False
        stack = [(0, 0)]
        while stack:
            v, depth = stack.pop()
            if after_leaf:
                gaps.append(depth)
                after_leaf = False
            below = down[v]
            if below is None:
                leaves.append(start[v] - depth)
                after_leaf = True
            else:
                depth += end[v] - start[v]
                stack += [(below[c], depth) for c in sorted(below, reverse=True)]
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.least = [np.array(gaps, np.int32)]
        while len(wide := self.least[-1]) > (half := 1 << (len(self.least) - 1)):
            self.least.append(np.minimum(wide[:-half], wide[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """LCE of the suffixes at i and j, elementwise; i and j differ."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.least[k][low[own]], self.least[k][high[own] - (1 << k)])
        return out


def _next_less(rank: list[int]) -> list[int]:
    """For each position the next one with a smaller rank, or the length."""
    out, open_ = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return out


def tree_runs(s: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``s``, symbols from 1, in order."""
    n = len(s)
    if n < min_length:
        return []
    ahead, back = Extensions([*s, 0]), Extensions([*s[::-1], 0])
    rank = ahead.rank[:n].tolist()
    at = np.arange(n)
    starts = np.concatenate([at, at])
    # The next greater suffix is the next smaller one of the mirrored ranks; the end of the text closes no such root.
    ends = np.array(_next_less(rank) + _next_less([-r for r in rank]), np.int64)
    period = ends - starts
    fits = (ends < n) & (min_exponent * period <= n)
    starts, period = starts[fits], period[fits]
    right = ahead(starts, starts + period)
    left = np.zeros(len(starts), np.int64)
    inner = starts > 0
    left[inner] = back(n - starts[inner], n - starts[inner] - period[inner])
    length = left + period + right
    good = (length >= min_length) & (length >= min_exponent * period)
    return sorted(set(zip((starts - left)[good].tolist(), length[good].tolist(), period[good].tolist(), strict=True)))


def least_grams(min_length: int, min_exponent: int) -> int:
    """How often each 3-gram of a run occurs in it at least."""
    return min((max(min_length, min_exponent * q) - 2) // q for q in range(1, min_length + 1))


def _kept(ids: np.ndarray, least: int) -> np.ndarray:
    """Starts of the 3-grams that occur ``least`` times."""
    pairs = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)[1]
    _, which, count = np.unique(pairs[:-1] * (ids.max() + 1) + ids[2:], return_inverse=True, return_counts=True)
    return np.flatnonzero(count[which] >= least)


def runs(words: list, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words, by start, then period; ``min_exponent`` is 2 or more."""
    codes: dict = {}
    ids = np.array([codes.setdefault(w, len(codes) + 1) for w in words], np.int64)
    where = np.arange(len(ids))
    least = least_grams(min_length, min_exponent)
    for _ in range(2 if least > 1 else 0):
        if len(ids) < min_length:
            return []
        grams = _kept(ids, least)
        if not len(grams):
            return []
        keep = np.zeros(len(ids), bool)
        keep[np.minimum(grams[:, None] + np.arange(3), len(ids) - 1)] = True
        # A new stretch begins where the 3-gram before does not reach: one unique word stands for the gap.
        first = np.flatnonzero(np.diff(grams, prepend=-2) > 1)
        cuts = grams[first]
        size = np.append(grams[first[1:] - 1], grams[-1]) + 3 - cuts
        total = len(ids) + len(codes) + 1
        parts, places = [], []
        for k, (a, m) in enumerate(zip(cuts.tolist(), size.tolist(), strict=True)):
            if m >= min_length:
                parts += [ids[a : a + m], [total + k]]
                places += [where[a : a + m], [-1]]
        if not parts:
            return []
        if len(parts) == 2 and size[0] == len(ids):
            break
        ids, where = np.concatenate(parts[:-1]), np.concatenate(places[:-1])
        ids = np.unique(ids, return_inverse=True)[1] + 1
    return [(int(where[a]), length, q) for a, length, q in tree_runs(ids.tolist(), min_length, min_exponent)]


def collapse(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    gone = np.zeros(len(words), bool)
    for start, length, q in found:
        gone[start + q : start + length] = True
    return [w for w, out in zip(words, gone.tolist(), strict=True) if not out] if found else words


OUT = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def collapse_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` without ``text``, with n_words, the runs and the words that stay, joined by one space."""
    kept = [c for c in docs.columns if c not in (text, "n_words", "runs", "collapsed")]
    schema = StructType([*docs.select(*kept).schema, *StructType.fromDDL(OUT)])
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, offsets, found, texts = [], [0], [], []
            for t in batch.column(text):
                words = (t.as_py() or "").encode().split()
                own = runs(words, min_length, min_exponent)
                counts.append(len(words))
                found += own
                offsets.append(len(found))
                texts.append(b" ".join(collapse(words, own)).decode())
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            listed = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"])
            out = [batch.column(c) for c in kept]
            out += [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), listed).cast(run_type), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, "n_words", "runs", "collapsed"])

    return docs.select(*kept, F.col(text)).mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the documents, by a checksum of the id, get a periodic tail.

    With h the checksum, g = h div 10 and n words, each word from a = g mod n on becomes word a + (i - a) mod p,
    p = 1 + (n - a) div (3 + g mod 8). A null id plants nothing.
    """
    doc_id = F.col("doc_id").cast("long")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(doc_id.alias("doc_id"), "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("ws"))
    rows = rows.withColumn("n", F.size("ws")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    edited = F.expr("array_join(transform(ws, (w, i) -> if(i < a, w, ws[int(a + (i - a) % p)])), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """The longest run of each document (ties: least start, then period), and digests of all runs and of the words that stay."""
    rows = collapse_runs(docs.select("doc_id", "text"))
    best = F.expr("array_min(transform(runs, r -> struct(-r.length AS less, r.start AS start, r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    rows = rows.withColumn("best", best)
    length = -F.col("best.less")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * -best.less) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
