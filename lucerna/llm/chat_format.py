"""Chat formatting: conversations rendered by a compiled template, with the spans that training loss counts.

Rows are dealt by conversation and sorted by turn (then role, then text); the template renders while rows stream
by, so memory is bounded by one Arrow batch, however long a conversation is. The output has one row for each
message: its part of the formatted conversation, and the spans (code points, end exclusive) under the loss mask.

Defined cases: null roles and texts count as empty; a null conv_id is a conversation of its own; a null turn comes
first; ties in turn are ordered by role and text, and repeated rows stay; an empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat_template import DEFAULT, END, START, Template, unescape, unheader

PARTS = "conv_id long, part long, formatted string, loss_spans array<struct<start:long,end:long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: Rows of an Arrow batch that is sent on.
ROWS = 2000


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _sent(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def rendered(template: Template, messages: Iterator[dict]) -> Iterator[tuple[str, list[dict]]]:
    """(text, loss spans) of each part; a part begins where the template itself writes the string that opens a turn."""
    texts, length, spans = [], 0, []
    for text, in_loss in template.pieces(messages=messages):
        if texts and not in_loss and text.startswith(START):
            yield "".join(texts), spans
            texts, length, spans = [], 0, []
        if text:
            if in_loss:
                spans.append({"start": length, "end": length + len(text)})
            texts.append(text)
            length += len(text)
    if texts:
        yield "".join(texts), spans


PART_SCHEMA = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
DIGEST_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def format_conversations(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, part, formatted, loss_spans: the formatted conversations in parts, in order inside each partition."""

    def run(batches):
        def rows():
            for conv, some in groupby(_rows(batches), key=lambda r: r["conv_id"]):
                for part, (text, spans) in enumerate(rendered(template, some)):
                    yield conv, part, text, spans

        return _sent(rows(), PART_SCHEMA)

    kept = turns.select(F.col("conv_id").cast("long"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, PARTS)


def read_back(formatted: str, spans: list[dict]) -> tuple[str, str, str]:
    """role, text and text under the loss mask, read from one part of the output."""
    head, _, rest = formatted.removeprefix(START).partition("\n")
    return unheader(head), unescape(rest[: rest.rindex(END)]), "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)


def conversation_digests(parts: DataFrame) -> DataFrame:
    """What ``format_conversations`` gives, read back: one row per conversation, with digests of turns and loss text."""

    def run(batches):
        def rows():
            for conv, some in groupby(_rows(batches), key=lambda r: r["conv_id"]):
                n = loss_chars = chars = 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
                for r in some:
                    role, text, masked = read_back(r["formatted"], r["loss_spans"])
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    loss.update(masked.encode("utf-8", "surrogatepass"))
                    n, loss_chars, chars = n + 1, loss_chars + len(masked), chars + len(r["formatted"])
                yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        return _sent(rows(), DIGEST_SCHEMA)

    return parts.mapInArrow(run, DIGESTS)


def formatted_digests(turns: DataFrame) -> DataFrame:
    """The digests of all conversations and of conversation -1, whose texts hold control strings."""
    hard = f"{END}{START}assistant ok"
    extra = turns.sparkSession.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return conversation_digests(format_conversations(turns.select("conv_id", "turn", "role", "text").unionByName(extra)))
