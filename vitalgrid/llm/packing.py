"""Vector bin packing of token sequences by the dot-product heuristic.

A sequence has three limits at once: tokens, segments (pieces) and loss-bearing tokens. A bin takes, again and again,
the piece whose demand has the largest weighted dot product with the room the bin has left. Each task packs its own
documents in pools of bounded size, so nothing is shuffled and no task holds more than a pool.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import slices, text_or_empty
from vitalgrid.llm.word_ids import word_ids


@dataclass(frozen=True)
class Limits:
    """Room of one sequence. ``pool``: pieces that compete for a bin; it bounds memory, not what is packed.
    ``least_cut``: the smallest piece that cutting may make; 0 never cuts to fill a gap."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048
    pool: int = 2048
    least_cut: int = 16


class Pool:
    """Pieces waiting for a sequence: (name, start, ids, whole length, tokens without loss at the document's start)."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.rows: list[tuple] = []
        self.ready: list[list[tuple]] = []

    @staticmethod
    def loss_of(piece: tuple) -> int:
        _, start, ids, _, free = piece
        return max(0, start + len(ids) - max(start, free))

    def add(self, name, ids: np.ndarray, free: int) -> None:
        """Cuts off full sequences; the rest competes. A piece never exceeds the token or the loss limit."""
        most, total = min(self.limits.tokens, self.limits.loss), len(ids)
        start = 0
        while total - start > most:
            piece = (name, start, ids[start : start + most], total, free)
            if most == self.limits.tokens:
                self.ready.append([piece])
            else:
                self.rows.append(piece)
            start += most
        if total - start == self.limits.tokens:
            self.ready.append([(name, start, ids[start:], total, free)])
        elif total > start:
            self.rows.append((name, start, ids[start:], total, free))

    def _demand(self, rows: list[tuple]) -> np.ndarray:
        return np.array([[len(r[2]), 1, self.loss_of(r)] for r in rows], np.float64).reshape(-1, 3)

    def pack(self, final: bool) -> Iterator[list[tuple]]:
        """Full sequences; the last pieces, too few for a sequence, wait for more unless this is the end."""
        yield from self.ready
        self.ready = []
        room_of = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], np.float64)
        rows = self.rows
        demand = self._demand(rows)
        waiting = np.ones(len(rows), bool)
        left = float(demand[:, 0].sum())
        while waiting.any() and (final or left >= self.limits.tokens):
            weight = demand[waiting].mean(axis=0) / room_of**2  # both vectors in shares of the limits
            room, chosen = room_of.copy(), []
            while True:
                score = np.where(waiting & (demand <= room).all(axis=1), demand @ (weight * room), -1.0)
                best = int(score.argmax()) if len(score) else -1
                if best < 0 or score[best] < 0:
                    break
                chosen.append(rows[best])
                waiting[best] = False
                room -= demand[best]
            gap = int(min(room[0], room[2]))
            if self.limits.least_cut and gap >= self.limits.least_cut and room[1] >= 1:
                long = np.where(waiting & (demand[:, 0] >= gap + self.limits.least_cut), demand[:, 0], -1.0)
                best = int(long.argmax()) if len(long) else -1
                if best >= 0 and long[best] > 0:
                    name, start, ids, total, free = rows[best]
                    chosen.append((name, start, ids[:gap], total, free))
                    rows[best] = (name, start + gap, ids[gap:], total, free)
                    demand[best] = self._demand([rows[best]])[0]
            left -= sum(len(r[2]) for r in chosen)
            yield chosen
        self.rows = [r for r, w in zip(rows, waiting, strict=True) if w]


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
)
PIECES = "doc_id long, start long, length long, doc_tokens long, loss_tokens long, sequence_id long, offset long, ids binary"


def _pieces(vocabulary: str, end_id: int, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = word_ids(vocabulary)
        pool = Pool(limits)
        number = TaskContext.get().partitionId() << 40

        def out(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows: list[tuple] = []
            for sequence in pool.pack(final):
                offset = 0
                for piece in sequence:
                    name, start, ids, total, _ = piece
                    raw = ids.astype("<u4").tobytes()
                    rows.append((name, start, len(ids), total, pool.loss_of(piece), number, offset, raw))
                    offset += len(ids)
                number += 1
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=_OUT)

        for batch in slices(batches, 1):
            coded = coder.encode(batch.column(1).to_pylist())
            for name, raw, free in zip(batch.column(0).to_pylist(), coded, batch.column(2).to_pylist(), strict=True):
                pool.add(name, np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)), free)
                if len(pool.rows) >= limits.pool:
                    yield from out(False)
        yield from out(True)

    return run


def pack_texts(
    docs: DataFrame,
    limits: Limits = Limits(),
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 1,
    no_loss: str | None = None,
) -> DataFrame:
    """Pieces of all documents in sequences: doc_id, start, length, doc_tokens, loss_tokens, sequence_id, offset, ids.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers. ``no_loss`` names a column with the number of
    leading tokens that bear no loss (null or none: all bear it). Null or empty text: the end id alone. Empty table: no
    rows. Repeated rows are packed each. Very long texts are cut at the token limit. A null doc_id stays null. Other
    columns are ignored, whatever their names.

    Sequence numbers carry the task's number, so they are unique without a count of all sequences.
    """
    free = F.coalesce(F.col(no_loss).cast("long"), F.lit(0)) if no_loss else F.lit(0).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), free.alias("free"))
    return rows.mapInArrow(_pieces(vocabulary, end_id, limits), PIECES)


def packed_documents(docs: DataFrame) -> DataFrame:
    """The pieces of ``pack_texts`` with a checksum in place of the ids."""
    packed = pack_texts(docs)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
