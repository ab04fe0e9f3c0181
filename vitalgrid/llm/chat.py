"""Chat formatting of typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens them in order into one string:
texts are escaped, every attachment becomes a placeholder that carries its number in the turn, and the visitor records
the attachment's reference and the tokens it will expand to.

Template. A turn is ``<turn role="R">`` + newline + content + ``</turn>`` + newline; an attachment is
``<K n="N"/>`` with K one of image, audio, document. In texts and roles ``&``, ``<``, ``[`` and ``"`` are written
``&amp;``, ``&lt;``, ``&lsqb;`` and ``&quot;``, so no text can hold a marker of this template or of the common
``<...>`` and ``[...]`` ones, and every text can be read back exactly. The loss mask is a span of code points in the
segment: the content of an assistant's turn, nothing else.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template, in the order they are written; they are read back in reverse.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ('"', "&quot;"))
#: Tokens that one unit of an attachment expands to: an image tile, a second of audio, a page of a document.
EXPANSION = {"image": 256, "audio": 25, "document": 512}
TURN = re.compile(r'<turn role="([^"<]*)">\n(.*?)</turn>\n', re.DOTALL)
PLACEHOLDER = re.compile(r'<(image|audio|document) n="([0-9]+)"/>')

PART = "kind string, text string, ref string, units long"


def escape(text: str) -> str:
    for plain, written in ESCAPES:
        text = text.replace(plain, written)
    return text


def unescape(text: str) -> str:
    for plain, written in reversed(ESCAPES):
        text = text.replace(written, plain)
    return text


class Flattener:
    """Visits one turn's parts in order."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown content part {kind!r}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)

    def _attach(self, kind: str, part: dict) -> None:
        tokens = EXPANSION[kind] * max(1, part.get("units") or 1)
        self.pieces.append(f'<{kind} n="{len(self.attachments)}"/>')
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "tokens": tokens})

    @property
    def content(self) -> str:
        return "".join(self.pieces)


def text_parts(text: Column) -> Column:
    """One text part from a plain text; null is the empty text."""
    part = F.struct(
        F.lit("text").alias("kind"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("long").alias("units"),
    )
    return F.array(part)


_SEGMENT = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("turn", pa.int64()),
        ("segment", pa.string()),
        ("loss_start", pa.int64()),
        ("loss_end", pa.int64()),
        ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))),
        ("expanded_tokens", pa.int64()),
    ]
)
SEGMENT = (
    "conv_id long, turn long, segment string, loss_start long, loss_end long, "
    "attachments array<struct<kind:string,ref:string,tokens:bigint>>, expanded_tokens long"
)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            seen = Flattener()
            for part in row["parts"] or []:
                if part is not None:
                    seen.visit(part)
            head = f'<turn role="{escape(row["role"] or "")}">\n'
            bears = row["role"] == "assistant"
            end = len(head) + len(seen.content)
            rows.append(
                {
                    "conv_id": row["conv_id"],
                    "turn": row["turn"],
                    "segment": f"{head}{seen.content}</turn>\n",
                    "loss_start": len(head) if bears else None,
                    "loss_end": end if bears else None,
                    "attachments": seen.attachments,
                    "expanded_tokens": sum(a["tokens"] for a in seen.attachments),
                }
            )
        yield pa.RecordBatch.from_pylist(rows, schema=_SEGMENT)


def format_turns(turns: DataFrame) -> DataFrame:
    """A formatted segment per turn of (conv_id, turn, role, parts); a conversation is its segments in turn order.

    Null parts or an empty list: empty content. Null role: the empty role. Null conv_id: a conversation of its own.
    Repeated rows are repeated turns. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "parts"
    ).mapInArrow(_format, SEGMENT)


_READ = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted segments; holds one conversation's running digests, never its text."""
    current: list | None = None
    key = object()

    def done() -> pa.RecordBatch:
        n, turns, loss_n, loss, size = current
        row = {"conv_id": key, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_n}
        row |= {"loss_sha256": loss.hexdigest(), "formatted_chars": size}
        return row

    for batch in batches:
        ended = []
        for row in batch.to_pylist():
            if current is None or row["conv_id"] != key:
                if current is not None:
                    ended.append(done())
                key, current = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            segment = row["segment"]
            for role, content in TURN.findall(segment):
                text = unescape(PLACEHOLDER.sub("", content))
                current[0] += 1
                current[1].update(f"{unescape(role)}\n{text}\n".encode())
            if row["loss_start"] is not None:
                text = unescape(PLACEHOLDER.sub("", segment[row["loss_start"] : row["loss_end"]]))
                current[2] += len(text)
                current[3].update(text.encode())
            current[4] += len(segment)
        if ended:
            yield pa.RecordBatch.from_pylist(ended, schema=_READ)
    if current is not None:
        yield pa.RecordBatch.from_pylist([done()], schema=_READ)


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, from the formatted segments alone: turns, digests of turns and of text under the loss mask.

    A digest over a conversation needs its turns one after the other, so one task reads a conversation as a sorted
    stream; memory stays bounded however long it is. Turns with the same number go by their segment.
    """
    ordered = segments.select("conv_id", "turn", "segment", "loss_start", "loss_end").repartition("conv_id")
    return ordered.sortWithinPartitions("conv_id", "turn", "segment").mapInArrow(
        _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
