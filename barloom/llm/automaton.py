"""Suffix automata of reference shards, broadcast; documents are streamed for matching statistics.

For a reference whose size has a bound (a benchmark, a list of licences): its texts are cut into shards of
``SHARD_WORDS`` words, each shard becomes a generalised suffix automaton over words, and every task walks
its documents through the automata. A walk keeps the longest suffix that occurs in the shard; where it
reaches ``least`` words, the words of the match are covered. Covered runs are the maximal spans.

A reference above ``MOST_WORDS`` words is refused: use ``passages`` for it.

Defined cases: null texts have no words; an empty reference covers nothing; equal reference texts count once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import arrow_map, word_count

SHARD_WORDS = 200_000
MOST_WORDS = 5_000_000


class Automaton:
    """Generalised suffix automaton: per state its length, suffix link and transitions by word."""

    def __init__(self) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]

    def _state(self, length: int, link: int, onward: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(onward)
        return len(self.length) - 1

    def add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _split(self, p: int, q: int, w: bytes) -> int:
        """A copy of q for the strings that end at p + w."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def matches(self, words: list[bytes]) -> np.ndarray:
        """Length of the longest match that ends at each word."""
        out, state, n = np.zeros(len(words), np.int64), 0, 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            to = self.next[state].get(w)
            state, n = (to, n + 1) if to is not None else (0, 0)
            out[i] = n
        return out


def spans(words: list[bytes], automata: list[Automaton], least: int) -> list[tuple[int, int]]:
    """Maximal runs of words that matches of ``least`` words or more cover; end exclusive."""
    marks = np.zeros(len(words) + 1, np.int64)
    for a in automata:
        found = a.matches(words)
        for end in np.nonzero(found >= least)[0]:
            marks[end + 1 - found[end]] += 1
            marks[end + 1] -= 1
    covered = np.cumsum(marks)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def automata_of(texts: list[str]) -> list[Automaton]:
    shards, size = [], SHARD_WORDS
    for text in dict.fromkeys(texts):
        words = text.encode("utf-8", "surrogatepass").split()
        if size + len(words) > SHARD_WORDS:
            shards.append(Automaton())
            size = 0
        shards[-1].add(words)
        size += len(words)
    return shards


def remove_reference(docs: DataFrame, reference: DataFrame, least: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words outside spans that occur in ``reference`` (column text)."""
    total = reference.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    if total > MOST_WORDS:
        raise ValueError(f"a reference of {total} words is too large to broadcast: {MOST_WORDS} at most")
    texts = [r["text"] for r in reference.filter(F.col("text").isNotNull()).select("text").distinct().collect()]
    sent = docs.sparkSession.sparkContext.broadcast(sorted(texts))
    built: list = []

    def run(batch: dict) -> dict:
        if not built:
            built.append(automata_of(sent.value))
        rows = []
        for text in batch["text"].to_pylist():
            words = (text or "").encode("utf-8", "surrogatepass").split()
            kept, at, gone = [], 0, 0
            for a, b in spans(words, built[0], least):
                kept += words[at:a]
                at, gone = b, gone + b - a
            rows.append((len(words), gone, b" ".join(kept + words[at:]).decode("utf-8", "surrogatepass")))
        return {"doc_id": batch["doc_id"], **dict(zip(("n_words", "n_removed", "kept"), zip(*rows, strict=True), strict=True))}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_words long, n_removed long, kept string")
