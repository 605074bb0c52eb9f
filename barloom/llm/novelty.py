"""Secret scans: fixed patterns, and novelty against dictionary-primed zstandard.

A candidate is a long run of token characters with a digit and a letter, in a sensitive context (a word
such as "key" or "credential" in the ``CONTEXT`` characters before it, or in the name it is glued to: a run is split at
each "=" but its padding, and after a name that ends in such a word). Its novelty is what it adds to the
compressed size when zstandard is primed with an identifier dictionary and the code around the
candidate: identifiers, paths and parts of what stands nearby cost next to nothing, random strings
cost their entropy. Neither candidates nor copies of the candidate prime it, and what is found in a sensitive place
is reported wherever else it stands in the text. A candidate that lies inside a span of the fixed patterns is known; one that reaches beyond
is measured whole. Candidates at ``MIN_NOVELTY`` bytes a character or more are reported as ``novel``.

Positions are code points, end exclusive. Defined cases: null or empty text has no spans; repeated rows
get equal results; empty tables give empty results; columns other than doc_id and text are not
read (``redacted`` hands them on).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import arrow_map

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Maximal runs, so the least length may stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A text without any of these has no match of ASSIGN.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
MIN_ASSIGN = 12

MIN_CANDIDATE = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=~-]{{{MIN_CANDIDATE},}}")
#: What stands between the "=" of a run, with the padding at its end.
VALUE = re.compile(r"[^=]+(?:=+\Z)?")
WORDS = "key|token|secret|passw|pwd|credential|auth|bearer|private|signature|cookie|session|cert|akia"
SENSITIVE = re.compile(f"(?ai){WORDS}")
#: A name up to the last sensitive word, without "=": stripe_key_, client-secret-.
NAMED = re.compile(f"(?ai)(?:[a-z]+[0-9]?[_~/+-]+)*[a-z]*(?:{WORDS})[a-z]{{0,3}}[_~/+-]+")
CONTEXT = 64
#: Characters of code on either side that prime the compressor.
SURROUNDING = 2_048
MIN_NOVELTY = 0.6
#: Fixed words: common identifiers of code and settings.
IDENTIFIERS = (
    "abstract address algorithm arguments array assert async authorization await backend base64 begin boolean "
    "buffer bytes cache callback certificate channel charset class client cluster column command commit config "
    "configuration connection const constructor container content context controller cookie count create credential "
    "customer database dataset datetime debug decode default delete dependency deploy description development "
    "dictionary directory document domain download email encode encoding encrypt endpoint environment error event "
    "example exception execute export extends factory false filename float format frontend function generate gateway "
    "handler header hostname identifier implements import include index initialize instance integer interface "
    "iterator kubernetes language length library license listener localhost location logger manager message "
    "metadata method middleware migration module namespace network notification null number object operation "
    "optional options organization output package parameter parent parse password pattern payload permission "
    "pipeline platform plugin pointer policy postgres prefix private process production profile project property "
    "protected protocol provider public python query queue readme reference region register registry repository "
    "request require resource response result return revision router runtime schedule schema scope script secret "
    "section security sequence serialize server service session settings signature source staging static status "
    "storage stream string struct subscription suffix summary system table target template terraform test thread "
    "timeout timestamp token transaction transform type undefined unicode update upload username utility validate "
    "value variable vector version virtual visible webhook widget window worker workspace yaml"
).encode()


def novelty(candidate: str, around: str) -> float:
    """Marginal compressed bytes per character, given the identifiers and the code around."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + around.encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    body = candidate.encode()
    empty = len(press.compress(b""))
    return (len(press.compress(body)) - empty) / len(body)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    spans = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    lowered = text.lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    return sorted(spans)


def candidates(text: str) -> list[tuple[int, int]]:
    """Values of token characters in sensitive context, without the names they are glued to, in order."""
    contexts = [m.span() for m in SENSITIVE.finditer(text)]
    if not contexts:
        return []
    starts, found = [c[0] for c in contexts], []
    for run in CANDIDATE.finditer(text):
        for m in VALUE.finditer(run[0]):
            a, b = run.start() + m.start(), run.start() + m.end()
            name = NAMED.match(text, a, b)
            if name and b - name.end() >= MIN_CANDIDATE:
                a = name.end()
            k = bisect_right(starts, a) - 1
            if b - a < MIN_CANDIDATE or k < 0 or a + MIN_CANDIDATE > contexts[k][1] + CONTEXT:
                continue
            body = text[a:b]
            if any(map(str.isdigit, body)) and any(map(str.isalpha, body)):
                found.append((a, b))
    return found


def _around(text: str, at: int, others: list[tuple[int, int]]) -> str:
    """The code around candidate ``at`` of ``others`` that is neither a candidate nor a copy of this one."""
    low, high = max(0, others[at][0] - SURROUNDING), others[at][1] + SURROUNDING
    first, last = at, at + 1
    while first and others[first - 1][1] > low:
        first -= 1
    while last < len(others) and others[last][0] < high:
        last += 1
    parts = []
    for start, end in others[first:last]:
        parts.append(text[low : max(low, start)])
        low = end
    return "".join([*parts, text[low:high]]).replace(text[slice(*others[at])], "")


def novel_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Incompressible strings in sensitive context, and their copies, that lie inside no span of ``known``, which is in order."""
    starts, ends = [s for s, _, _ in known], list(accumulate((e for _, _, e in known), max))

    def inside(a: int, b: int) -> bool:
        before = bisect_right(starts, a)
        return bool(before) and ends[before - 1] >= b

    others = candidates(text)
    found = {
        text[a:b] for at, (a, b) in enumerate(others) if not inside(a, b) and novelty(text[a:b], _around(text, at, others)) >= MIN_NOVELTY
    }
    if not found:
        return []
    copies = ahocorasick.Automaton()
    for word in found:
        copies.add_word(word, len(word))
    copies.make_automaton()
    spans = [(last + 1 - size, 3, last + 1) for last, size in copies.iter(text)]
    return sorted(s for s in spans if not inside(s[0], s[2]))


def all_spans(text: str | None) -> tuple[list, list]:
    base = base_spans(text or "")
    return base, sorted(base + novel_spans(text or "", base))


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel."""

    def run(batch: dict) -> dict:
        rows = []
        for text in batch["text"].to_pylist():
            base, every = all_spans(text)
            counts = [sum(s[1] == k for s in every) for k in range(4)]
            rows.append((*counts[:3], hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every), counts[3]))
        names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")
        return {"doc_id": batch["doc_id"], **dict(zip(names, zip(*rows, strict=True), strict=True))}

    return arrow_map(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long",
    )


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with each span, or run of overlapping spans, replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in all_spans(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """All documents with their secrets replaced; ``n_chars``, if there, follows the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redact(t) for t in batch.column("text").to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["text"] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in columns:
                kept = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, kept, strict=True)], pa.int64()).cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
