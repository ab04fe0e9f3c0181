"""Token ids in Simple-8b words: selectors, escapes and offsets, read and written in whole blocks.

File format. A table of blocks, one row each, in Parquet below one folder:

* ``part``, ``block``: a block's place; (part, block) ascending is ascending document order.
* ``first_id``: ids in the same part before this block.
* ``doc_ids``, ``doc_lengths``: the block's documents in order, and the ids of each (end id included).
* ``words``: little-endian unsigned 64-bit words. The top four bits select how the other 60 are cut.
* ``offsets``: little-endian unsigned 32-bit numbers; entry g is the first word of the ids g * 128 and up, with one
  more entry for the end. A run of 128 ids starts in a word of its own, so any run decodes by itself.

Selectors give (ids in the word, bits for each): see ``CUTS``. The last word of a run may hold fewer ids. Selector 0 is
the escape: its own 60 bits are unused and the next word is one raw id, for values of more than 60 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import slices, text_or_empty
from vitalgrid.llm.word_ids import word_ids
from vitalgrid.session import scratch_dir

# Fixed values of the format: ids per word and bits per id, by selector from 1.
CUTS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
RUN = 128
ESCAPE = 0

BLOCK_SCHEMA = (
    "part int, block int, first_id long, doc_ids array<long>, doc_lengths array<long>, words binary, offsets binary"
)
_MASK = np.uint64((1 << 60) - 1)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and run offsets of unsigned integers. All runs advance together, one word each per step."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    runs = -(-n // RUN)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    grid = np.zeros((runs, RUN + 60), np.uint64)
    padded = np.zeros(runs * RUN, np.uint64)
    padded[:n] = values
    grid[:, :RUN] = padded.reshape(runs, RUN)
    left = np.full(runs, RUN, np.int64)
    left[-1] = n - (runs - 1) * RUN
    # the largest count whose values i .. i + count - 1 all fit; past the end they are 0 and fit any width
    steps = np.array([1 << bits for _, bits in CUTS], np.uint64)
    if int(values.max()) < 1 << 16:
        table = np.searchsorted(steps, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)
        width = table[grid.astype(np.uint16)]
    else:
        width = np.searchsorted(steps, grid, side="right").astype(np.uint8)
    # largest[k]: the widest of 2^k values from each place; any window is two such that overlap
    largest, have = [width], 1
    while 2 * have <= CUTS[0][0]:
        wide = largest[-1].copy()
        np.maximum(wide[:, :-have], largest[-1][:, have:], out=wide[:, :-have])
        largest.append(wide)
        have *= 2
    choice = np.zeros(grid.shape, np.uint8)
    for s in range(len(CUTS), 0, -1):
        count = CUTS[s - 1][0]
        k = count.bit_length() - 1
        window, step = largest[k].copy(), count - (1 << k)
        if step:
            np.maximum(window[:, :-step], largest[k][:, step:], out=window[:, :-step])
        np.copyto(choice, np.uint8(s), where=window < s)
    counts = np.array([1] + [c for c, _ in CUTS], np.int64)
    # the places where words begin: every run goes on by the count its selector packs
    at, live, found = np.zeros(runs, np.int64), np.arange(runs), []
    while len(live):
        pos = at[live]
        sel = choice[live, pos].astype(np.int64)
        found.append((live, pos, sel))
        at[live] = pos + counts[sel]
        live = live[at[live] < left[live]]
    row, pos, sel = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(row, kind="stable")  # words of a run side by side, in order
    row, pos, sel = row[order], pos[order], sel[order]
    size = 1 + (sel == ESCAPE)
    ends = np.cumsum(size)
    slot = ends - size
    words = np.zeros(int(ends[-1]), np.uint64)
    flat, place = grid.ravel(), row * grid.shape[1] + pos
    for s, (count, bits) in enumerate(CUTS, 1):
        some = np.flatnonzero(sel == s)
        if len(some):
            body = np.full(len(some), s << 60, np.uint64)
            for j in range(count):
                body |= flat[place[some] + j] << np.uint64(j * bits)
            words[slot[some]] = body
    raw = np.flatnonzero(sel == ESCAPE)
    words[slot[raw] + 1] = flat[place[raw]]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, weights=size, minlength=runs).astype(np.int64))])
    return words, offsets.astype(np.uint32)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The values again; words of one selector are cut together."""
    if not n:
        return np.zeros(0, np.uint64)
    words = np.asarray(words, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(sel == ESCAPE):  # a word after an escape is raw, whatever its top bits say
        if not raw[i]:
            raw[i + 1] = True
    sel[raw] = ESCAPE
    counts = np.array([0] + [c for c, _ in CUTS], np.int64)[sel]
    counts[raw] = 1
    starts = np.asarray(offsets[:-1], np.int64)
    ends = np.asarray(offsets[1:], np.int64)
    runs = len(starts)
    held = np.full(runs, RUN, np.int64)
    held[-1] = n - (runs - 1) * RUN
    total = np.concatenate([[0], np.cumsum(counts)])
    counts[ends - 1] -= (total[ends] - total[starts]) - held  # the last word of a run may be part full
    place = np.concatenate([[0], np.cumsum(counts)])[:-1]
    out = np.zeros(n, np.uint64)
    body = words & _MASK
    for s, (count, bits) in enumerate(CUTS, 1):
        rows = np.flatnonzero(sel == s)
        for j in range(count if len(rows) else 0):
            some = rows[counts[rows] > j]
            out[place[some] + j] = (body[some] >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
    rows = np.flatnonzero(raw)
    out[place[rows]] = words[rows]
    return out


def _block(part: int, block: int, first: int, doc_ids: list, lengths: list[int], ids: np.ndarray) -> dict:
    words, offsets = pack(ids)
    return {
        "part": part,
        "block": block,
        "first_id": first,
        "doc_ids": doc_ids,
        "doc_lengths": lengths,
        "words": words.astype("<u8").tobytes(),
        "offsets": offsets.astype("<u4").tobytes(),
    }


def _arrow_schema() -> pa.Schema:
    long_list = pa.list_(pa.int64())
    return pa.schema(
        [("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("doc_ids", long_list), ("doc_lengths", long_list), ("words", pa.binary()), ("offsets", pa.binary())]
    )


def encode_blocks(vocabulary: str, end_id: int, block_ids: int):
    """For mapInArrow over sorted (doc_id, text): blocks of at least ``block_ids`` ids, whole documents each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = word_ids(vocabulary)
        block = first = held = 0
        docs: list = []
        lengths: list[int] = []
        parts: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal block, first, held, docs, lengths, parts
            row = _block(part, block, first, docs, lengths, np.frombuffer(b"".join(parts), "<u4"))
            block, first, held, docs, lengths, parts = block + 1, first + held, 0, [], [], []
            return pa.RecordBatch.from_pylist([row], schema=_arrow_schema())

        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, 1):
            coded = coder.encode(batch.column(1).to_pylist())
            for name, raw in zip(batch.column(0).to_pylist(), coded, strict=True):
                docs.append(name)
                lengths.append(len(raw) // 4 + 1)
                parts += [raw, end]
                held += lengths[-1]
                if held >= block_ids:
                    yield close()
        if docs:
            yield close()

    return run


def write_token_file(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1, block_ids: int = 1 << 17) -> None:
    """Encodes every text (null: empty), adds ``end_id`` and writes blocks in ascending doc_id order.

    Equal doc_ids go by their texts; a null doc_id comes first. Texts move once, by range; the parts are as many as
    the session's shuffle partitions.
    """
    rows = docs.select(F.col("doc_id"), text_or_empty().alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(encode_blocks(vocabulary, end_id, block_ids), BLOCK_SCHEMA).write.parquet(path)


def decode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (first_id, doc_ids, doc_lengths, words, offsets): a row per document."""
    for batch in batches:
        for row in batch.to_pylist():
            sizes = np.asarray(row["doc_lengths"], np.int64)
            upto = np.cumsum(sizes)
            words = np.frombuffer(row["words"], "<u8")
            ids = unpack(words, np.frombuffer(row["offsets"], "<u4"), int(upto[-1])).astype("<u4")
            raw = memoryview(ids.view(np.uint8))
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(upto.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["first_id"] + upto - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_file(spark, path: str) -> DataFrame:
    """A row per document of the files: doc_id, start, n_tokens, ids_crc32.

    Only the parts' totals are put in order in one place, one row for each file part.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    count = F.aggregate("doc_lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = blocks.groupBy("part").agg(F.max(F.col("first_id") + count).alias("ids"))
    before = _running(totals)
    placed = blocks.join(F.broadcast(before), "part").select(
        (F.col("first_id") + F.col("before")).alias("first_id"), "doc_ids", "doc_lengths", "words", "offsets"
    )
    return placed.mapInArrow(decode_blocks, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _running(totals: DataFrame) -> DataFrame:
    """Ids before each part: one row per file part, so this one ordered window is bounded by the number of parts."""
    from pyspark.sql import Window

    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("before"))


def token_file(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Writes the documents' ids below the shared folder and returns what reading the files gives.

    Empty table: no rows. Null text: the end id alone. Repeated rows: each gets its own place. Other columns of
    ``docs`` are ignored, whatever their names.
    """
    path = scratch_dir(docs.sparkSession, "token-file")
    write_token_file(docs, vocabulary, path, end_id)
    return read_token_file(docs.sparkSession, path)
