"""Quality by distribution divergence from language references.

The reference of a language holds the shares of character classes and of its most common words over all
documents of the language that pass the base rules. A document is judged by the Jensen-Shannon
divergence (base 2, 0 to 1; its root is the distance) of its own shares from the reference: on
classes if it has ``MIN_CHARS`` characters, on words if it has ``MIN_WORDS`` words. Below these guards,
and for a language whose reference is thin, there is no verdict and only the base rules count. A document
that mixes languages is held against each reference; the nearest counts.

One text repeated over and over would bend a reference, so a text with more than a thousandth of all
rows counts once; there are fewer than a thousand such texts.

Defined cases: null text has no words and fails the base; null or empty language: nearest of all
references; repeated rows get equal verdicts; an empty table gives an empty result; other columns
are not read (``kept_documents`` hands them on).
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import arrow_map
from barloom.session import cut_lineage

MIN_BASE_WORDS = 10
REPEAT_PERCENT = 20
MIN_CHARS = 200
MIN_WORDS = 60
#: A distance (root of a divergence) is allowed up to a + b / sqrt(length): short texts scatter more.
CLASS_LIMIT = (0.12, 3.2)
WORD_LIMIT = (0.24, 2.0)
COMMON = 64
#: A reference of fewer words gives no verdict.
REFERENCE_WORDS = 5_000
HEAVY = 1_000
#: Distinct words that a task holds before it hands on partial counts.
HELD = 200_000

SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "symbol", "letter", "other")


def _class_of(char: str) -> int:
    kind = unicodedata.category(char)
    if char in " \t\n\r\x0b\x0c":
        return 3
    if char in ".,;:?!'\"()-":
        return 4
    return {"Ll": 0, "Lu": 1, "Nd": 2}.get(kind, {"P": 5, "S": 6, "L": 7}.get(kind[0], 8))


CLASS_OF = np.array([_class_of(chr(c)) for c in range(0x3000)], dtype=np.uint8)


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = points < len(CLASS_OF)
    counts = np.bincount(CLASS_OF[points[low]], minlength=len(CLASSES))
    counts[7] += len(points) - int(low.sum())
    return counts


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    row = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    key, base = row[:n], len(ids)
    for i in range(1, window):
        if base * len(ids) >= 1 << 62:  # keep keys exact: ranks instead of products
            key = np.unique(key, return_inverse=True)[1]
            base = int(key.max()) + 1
        key, base = key * len(ids) + row[i : n + i], base * len(ids)
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.nonzero(np.isin(key, twice))[0]
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    lines, seen, repeated_lines = text.split("\n"), set(), 0
    for line in lines:
        if line in seen:
            repeated_lines += 1
        elif line.strip(" \t\r\x0b\x0c"):
            seen.add(line)
    repeats = repeated_words(words)
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    return n, chars, sum(map(text.count, SYMBOLS)), repeated_lines, repeats, n < MIN_BASE_WORDS or 100 * repeats > REPEAT_PERCENT * n


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence of two count vectors, base 2."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        sides = [np.nansum(np.where(x > 0, x * np.log2(x / m), 0.0)) for x in (p, q)]
    return max(0.0, float(sum(sides)) / 2)


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """lang -> class counts, index of its common words, counts of these words and (last) of all others."""
    narrow = docs.select("text", "lang", F.xxhash64("text").alias("h"))
    total = docs.count()
    often = {r["h"]: r["count"] for r in narrow.groupBy("h").count().filter(F.col("count") * HEAVY > total).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of: dict[str, Counter] = defaultdict(Counter)
        classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES)))

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counter in [*words_of.items(), *classes.items()]:
                if isinstance(counter, Counter):
                    bins, counts = pa.array(counter.keys(), pa.binary()), pa.array(counter.values(), pa.float64())
                else:
                    bins, counts = pa.array([b" %d" % i for i in range(len(CLASSES))], pa.binary()), pa.array(counter)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(bins)), bins, counts], ["lang", "bin", "n"])
            words_of.clear()
            classes.clear()

        for batch in batches:
            for text, lang, h in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if lang is None or base_counts(text or "", words)[-1]:
                    continue
                share = 1.0 / often.get(h, 1)
                lowered = text.lower().encode("utf-8", "surrogatepass").split()
                if share == 1.0:
                    words_of[lang].update(lowered)
                else:
                    for w, n in Counter(lowered).items():
                        words_of[lang][w] += n * share
                classes[lang] += class_counts(text) * share
            if sum(map(len, words_of.values())) > HELD:
                yield from flush()
        yield from flush()

    # A class bin starts with a blank, which no word can hold.
    counted = narrow.mapInArrow(run, "lang string, bin binary, n double").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted)
    is_class = F.substring("bin", 1, 1) == F.lit(b" ")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "bin"))
    top = counted.filter(~is_class).withColumn("rank", rank).filter(F.col("rank") <= COMMON).drop("rank")
    totals = counted.filter(~is_class).groupBy("lang").agg(F.lit(b"").alias("bin"), F.sum("n").alias("n"))
    out: dict = {}
    rows = counted.filter(is_class).union(top).union(totals).collect()
    for lang in {r["lang"] for r in rows}:
        own = {bytes(r["bin"]): r["n"] for r in rows if r["lang"] == lang}
        words = sorted(w for w in own if w and not w.startswith(b" "))
        if own.get(b"", 0.0) < REFERENCE_WORDS:
            continue
        counts = np.array([own[w] for w in words])
        out[lang] = (
            np.array([own.get(b" %d" % i, 0.0) for i in range(len(CLASSES))]),
            {w: i for i, w in enumerate(words)},
            np.append(counts, max(0.0, own[b""] - counts.sum())),
        )
    return out


def judge(text: str, n_words: int, refs: dict, lang: str | None) -> tuple[float | None, float | None, bool]:
    """Distances of classes and words to the nearest reference (None: not judged), and whether the document is kept."""
    if not refs or len(text) < MIN_CHARS or (lang and lang not in refs):
        return None, None, True
    class_limit = CLASS_LIMIT[0] + CLASS_LIMIT[1] / len(text) ** 0.5
    word_limit = WORD_LIMIT[0] + WORD_LIMIT[1] / max(1, n_words) ** 0.5
    classes = class_counts(text)
    lowered = Counter(text.lower().encode("utf-8", "surrogatepass").split()) if n_words >= MIN_WORDS else None
    best: tuple[float, float | None, bool] | None = None
    for name in ([lang] if lang in refs else []) + [x for x in refs if x != lang]:
        ref_classes, index, ref_words = refs[name]
        by_class = divergence(classes, ref_classes) ** 0.5
        by_word = None
        if lowered is not None:
            own = np.zeros(len(ref_words))
            for w, i in index.items():
                own[i] = lowered.get(w, 0)
            own[-1] = lowered.total() - own.sum()
            by_word = divergence(own, ref_words) ** 0.5
        fine = by_class <= class_limit and (by_word is None or by_word <= word_limit)
        if best is None or (fine, -by_class) > (best[2], -best[0]):
            best = (by_class, by_word, fine)
        if fine:
            break
    return best


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, class_distance, word_distance."""
    refs = references(docs)

    def run(batch: dict) -> dict:
        rows = []
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
            text = text or ""
            words = text.encode("utf-8", "surrogatepass").split()
            base = base_counts(text, words)
            a, b, fine = judge(text, base[0], refs, lang)
            rows.append((*base, fine and not base[-1], a, b))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
        return {"doc_id": batch["doc_id"], **dict(zip(names, zip(*rows, strict=True), strict=True))}

    return arrow_map(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"),
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, class_distance double, word_distance double",
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns, in one pass."""
    refs = references(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                text = text or ""
                words = text.encode("utf-8", "surrogatepass").split()
                keep.append(not base_counts(text, words)[-1] and judge(text, len(words), refs, lang)[2])
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
