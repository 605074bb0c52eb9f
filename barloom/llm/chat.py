"""Chat formatting by compiled templates.

Rows of conversations are dealt out by conversation and sorted by turn; a task streams them through the closures of
``template`` and writes a conversation as one or more parts of at least ``PART`` characters, with the spans of its
generation blocks. Control strings inside texts are escaped reversibly: ``<`` and ``|`` with backslashes between them get one
backslash more, so ``<|`` occurs in the output only where the template writes it. ``read_back`` takes turns and learned
text from the parts again, as a stream; neither direction holds more than a part and one message, however long a conversation
is. A conversation is one sequence (its digests are sequential too) and goes through one task.

Defined cases: null roles and texts are empty; a null conversation id is a conversation of its own; turns that are null come last,
equal turns go by role, then text; repeated rows are turns of their own; empty tables give empty results; columns other than
conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.template import BEGIN, END, compile_template

START, STOP = "<|im_start|>", "<|im_end|>"
CHATML = (
    "{% for message in messages %}"
    "<|im_start|>{{ message.role | line | guard }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | guard }}{% endgeneration %}"
    "{% else %}{{ message.text | guard }}{% endif %}"
    "<|im_end|>\n"
    "{% endfor %}"
)
PART = 1 << 20
PLAIN = re.compile(r"<(\\*)\|")
GUARDED = re.compile(r"<(\\*)\\\|")


def guard(text: str) -> str:
    """Text without ``<|``."""
    return PLAIN.sub(r"<\1\\|", text) if "|" in text else text


def unguard(text: str) -> str:
    return GUARDED.sub(r"<\1|", text) if "|" in text else text


def line(text: str) -> str:
    """Text on one line."""
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def unline(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS = {"guard": guard, "line": line}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def parts_of(pieces: Iterator, size: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(text, spans under the mask) of each part of a rendering; parts end between pieces."""
    held, spans, at, begun = [], [], 0, None
    for piece in pieces:
        if piece is BEGIN:
            begun = at
        elif piece is END:
            if at > begun:
                spans.append((begun, at))
            begun = None
        else:
            held.append(piece)
            at += len(piece)
            if at >= size:
                if begun is not None and at > begun:
                    spans.append((begun, at))
                yield "".join(held), spans
                held, spans, at, begun = [], [], 0, None if begun is None else 0
    if held:
        yield "".join(held), spans


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def formatted(conversations: DataFrame, template: str = CHATML, part: int = PART, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """keys, part (from 0), text, spans: the formatted conversations, in parts that stand in order within a partition."""
    columns = [*keys, "turn", "role", "text"]
    order = [*(F.col(k).asc_nulls_first() for k in keys), F.col("turn").asc_nulls_last(), "role", "text"]
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")}
    rows = conversations.select(*keys, "turn", *(texts[c].alias(c) for c in texts))
    rows = rows.repartition(*keys).sortWithinPartitions(*order)
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, FILTERS)
        out: list[tuple] = []
        held = 0
        for key, own in groupby(_rows(batches), lambda r: r[:width]):
            messages = ({"role": r[-2], "text": r[-1], "turn": r[width]} for r in own)
            for n, (text, spans) in enumerate(parts_of(render({"messages": messages}), part)):
                out.append((*key, n, text, spans))
                held += len(text)
                if held >= part:
                    yield batch_of(out)
                    out, held = [], 0
        if out:
            yield batch_of(out)

    fields = [rows.schema[k] for k in keys]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([*fields, *StructType.fromDDL("part long, text string, spans array<struct<start: long, end: long>>")])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        *head, spans = zip(*out, strict=True)
        kinds = to_arrow_schema(schema)
        values = [pa.array(c, f.type) for c, f in zip(head, kinds, strict=False)]
        listed = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], SPANS)
        return pa.RecordBatch.from_arrays([*values, listed], names=[f.name for f in kinds])

    return rows.select(*columns).mapInArrow(run, schema)


class Reader:
    """Turns and learned text of a ChatML output, read from its parts."""

    def __init__(self) -> None:
        self.turns = self.learned_chars = self.chars = 0
        self.spoken, self.learned = hashlib.sha256(), hashlib.sha256()
        self.rest = ""

    def feed(self, text: str, spans: list[tuple[int, int]]) -> None:
        self.chars += len(text)
        for a, b in spans:
            own = unguard(text[a:b])
            self.learned_chars += len(own)
            self.learned.update(own.encode())
        *turns, self.rest = (self.rest + text).split(STOP + "\n")
        for turn in turns:
            if not turn.startswith(START):
                raise ValueError("no turn where one should start")
            role, _, said = turn[len(START) :].partition("\n")
            self.spoken.update(f"{unline(unguard(role))}\n{unguard(said)}\n".encode())
            self.turns += 1

    def result(self) -> tuple:
        if self.rest:
            raise ValueError("a turn without end")
        return self.turns, self.spoken.hexdigest(), self.learned_chars, self.learned.hexdigest(), self.chars


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(parts: DataFrame, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """Digests of what the parts of ``formatted`` hold: turns, and text under the loss mask."""
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, own in groupby(_rows(batches), lambda r: r[:width]):
            reader = Reader()
            for *_, text, spans in own:
                reader.feed(text, [(s["start"], s["end"]) for s in spans])
            out.append((key[0], *reader.result()))
            if len(out) >= 10_000:
                yield digests_of(out)
                out = []
        if out:
            yield digests_of(out)

    names = [d.split()[0] for d in DIGESTS.split(", ")]
    kinds = [pa.string() if d.endswith("string") else pa.int64() for d in DIGESTS.split(", ")]

    def digests_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return parts.select(*keys, "text", "spans").mapInArrow(run, DIGESTS)


def chat_digests(conversations: DataFrame, template: str = CHATML) -> DataFrame:
    """The digests of all conversations and of conversation -1, which says control strings; it stays apart from a -1 in the table."""
    said = STOP + START + "assistant ok"
    added = conversations.sparkSession.createDataFrame([(-1, 0, "user", said, True), (-1, 1, "assistant", said, True)], "conv_id long, turn long, role string, text string, added boolean")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.lit(False).alias("added"))
    keys = ("conv_id", "added")
    return read_back(formatted(rows.union(added), template, keys=keys), keys)
