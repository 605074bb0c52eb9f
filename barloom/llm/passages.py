"""Substring dedup: words inside 50-word windows that also start in an earlier document are removed.

Every document is a reference for all later ones. Suffix automata of all of them, sent to every task, would
grow with the corpus, so the shards of the reference are met by key instead:

1. A window's *anchor* is its minimal 16-gram. Equal windows have equal anchors at the same place, and one
   anchor serves a run of consecutive windows; the words of that run are the anchor's *context*.
2. Contexts that several documents share are settled at once: each window of the context starts in the
   smallest of them, so for all others it is covered.
3. Only where one anchor has several contexts, the smallest document of each context (a leader) is looked at
   window by window: a window is covered if a smaller document leads it as well. Any document that has a
   window has the context of some leader of this window with no larger id, so that is exact.

All keys are reduced by minimum with partial aggregation, and rows get the minimum of their key back by a join in which keys
with more than one row in ``common.HOT`` are broadcast (at most ``HOT`` of them), so a passage in a third of all documents has
no task of its own; copies of a text never meet in pairs. Keys are 64-bit hashes of word sequences.

For a reference of bounded size, ``automaton`` has the broadcast form: suffix automata of its shards, through
which documents are streamed for matching statistics.

Defined cases: null text has no words; texts under 50 words stay whole; rows without an id are neither
references nor changed; rows with equal ids are one document; repeats inside one document stay; empty tables
give empty results; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import arrow_map, matched, mix64
from barloom.session import stored

WINDOW = 50
ANCHOR = 16
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Sequence:
    """Hashes of word ranges of one text: differences of sums of word * BASE**place, moved to place 0."""

    def __init__(self, words: list[bytes]) -> None:
        n = len(words)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        powers = np.cumprod(np.full(n + 1, BASE, np.uint64))
        self.back = np.cumprod(np.full(n + 1, INVERSE, np.uint64))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers[:n])))

    def ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64))


def anchors(seq: Sequence, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, context hash, first and last window of each run of windows with one anchor."""
    if n < WINDOW:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    starts = np.arange(n - ANCHOR + 1)
    grams = seq.ranges(starts, starts + ANCHOR)
    bits = np.uint64(24 if n < 1 << 24 else 32)
    least = (grams >> bits << bits) | starts.astype(np.uint64)
    span, width = WINDOW - ANCHOR + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: -(span - width)], least[span - width :])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.concatenate(([0], np.nonzero(place[1:] != place[:-1])[0] + 1))
    last = np.append(first[1:] - 1, len(place) - 1)
    return grams[place[first]], seq.ranges(first, last + WINDOW), first, last


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _anchor_rows(batch: dict) -> dict:
    ids, hs, contexts, sizes = batch["doc_id"], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], []
    for text in batch["text"].to_pylist():
        words = _words(text)
        h, c, _, _ = anchors(Sequence(words), len(words)) if len(words) >= WINDOW else ((), (), (), ())
        sizes.append(len(h))
        if len(h):
            hs.append(h)
            contexts.append(c)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return {"doc_id": ids.take(rows), "anchor": np.concatenate(hs).view(np.int64), "context": np.concatenate(contexts).view(np.int64)}


def _window_rows(batch: dict) -> dict:
    """The windows of the contexts that a document leads."""
    found, sizes = [np.zeros(0, np.uint64)], []
    for text, lead in zip(batch["text"].to_pylist(), batch["lead"].to_pylist(), strict=True):
        words, lead = _words(text), np.array(lead or [], np.int64).view(np.uint64)
        seq = Sequence(words)
        _, contexts, first, last = anchors(seq, len(words))
        own = np.nonzero(np.isin(contexts, lead))[0]
        at = np.concatenate([np.arange(first[i], last[i] + 1) for i in own]) if len(own) else np.zeros(0, np.int64)
        found.append(seq.ranges(at, at + WINDOW))
        sizes.append(len(at))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return {"doc_id": batch["doc_id"].take(rows), "window": np.concatenate(found).view(np.int64)}


def covered_words(words: list[bytes], contexts: list[int] | None, windows: list[int] | None) -> np.ndarray:
    """Which words are covered, given the document's covered contexts and windows."""
    marks = np.zeros(len(words) + 1, np.int64)
    if (contexts or windows) and len(words) >= WINDOW:
        seq = Sequence(words)
        _, found, first, last = anchors(seq, len(words))
        for i in np.nonzero(np.isin(found, np.array(contexts or [], np.int64).view(np.uint64)))[0]:
            marks[first[i]] += 1
            marks[last[i] + WINDOW] -= 1
        if windows:
            starts = np.arange(len(words) - WINDOW + 1)
            hit = starts[np.isin(seq.ranges(starts, starts + WINDOW), np.array(windows, np.int64).view(np.uint64))]
            np.add.at(marks, hit, 1)
            np.add.at(marks, hit + WINDOW, -1)
    return np.cumsum(marks)[:-1] > 0


def _kept_rows(batch: dict) -> dict:
    rows = []
    for text, contexts, windows in zip(batch["text"].to_pylist(), batch["contexts"].to_pylist(), batch["windows"].to_pylist(), strict=True):
        words = _words(text)
        gone = covered_words(words, contexts, windows)
        removed = int(gone.sum())
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed else words
        rows.append((len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest()))
    return {"doc_id": batch["doc_id"], **dict(zip(("n_words", "n_removed", "kept_sha256"), zip(*rows, strict=True), strict=True))}


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.filter(F.col("doc_id").isNotNull())
    found = stored(arrow_map(known, _anchor_rows, "doc_id long, anchor long, context long"))
    rows = F.count(F.lit(1)).alias("n")
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), rows).filter("a < b")
    suspect = stored(matched(found, stored(shared.select("anchor", "n")), ["anchor"]).select("doc_id", "anchor", "context"))
    leads = stored(suspect.groupBy("anchor", "context").agg(F.min("doc_id").alias("leader"), rows))
    several = stored(leads.groupBy("anchor").agg(rows).filter("n > 1"))
    lead = matched(leads.drop("n"), several, ["anchor"]).groupBy(F.col("leader").alias("doc_id")).agg(F.collect_set("context").alias("lead"))
    followed = matched(suspect, leads, ["anchor", "context"]).filter("doc_id > leader")
    contexts = followed.groupBy("doc_id").agg(F.collect_set("context").alias("contexts"))
    windows = stored(arrow_map(docs.join(lead, "doc_id").select("doc_id", "text", "lead"), _window_rows, "doc_id long, window long"))
    earliest = stored(windows.groupBy("window").agg(F.min("doc_id").alias("first"), rows).filter("n > 1"))
    covered = matched(windows, earliest, ["window"]).filter("doc_id > first").groupBy("doc_id").agg(F.collect_set("window").alias("windows"))
    marked = contexts.join(covered, "doc_id", "full")
    return arrow_map(
        docs.join(marked, "doc_id", "left").select("doc_id", "text", "contexts", "windows"),
        _kept_rows,
        "doc_id long, n_words long, n_removed long, kept_sha256 string",
    )
