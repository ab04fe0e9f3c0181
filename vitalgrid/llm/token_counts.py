"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair tokens.

A byte-pair encoding is the only way to cut a text into tokens in which every two neighbours stay apart when their
bytes are encoded together. So the encoding of a prefix ends in one token t, and before t stands the encoding of the
prefix without t's bytes: ``count[i] = count[i - len(t)] + 1``, where t is the one token that ends at i and stays apart
from the last token at i - len(t). One pass over a word thus gives its count at every prefix, and sums over the words
before give the count at every prefix of the text; truncation and budget questions need no second encoding.

A text falls into units: white space and the run of other characters after it. No token crosses from one unit to the
next and no unit changes the cut of another, whatever the prefix. Units are memoised by the worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import slices, text_or_empty, worker_state

# Fixed value: the pattern that the byte-level vocabulary's library cuts a text by.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MEMO_UNITS = 1_000_000


def byte_letters() -> dict[str, int]:
    """Byte of each letter in the vocabulary file: printable bytes stand for themselves, the others follow 255."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounts:
    """Counts for one byte-level vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        of = byte_letters()
        raw = {name: bytes(of[c] for c in name) for name in spec["model"]["vocab"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.pieces = regex.compile(PIECES).findall
        self.units = regex.compile(r"\s*\S+|\s+").findall
        # a token is named by the rank of the merge that makes it; single bytes are below 0
        self.rank: dict[tuple[int, int], int] = {}
        self.token: dict[bytes, int] = {bytes([b]): b - 256 for b in range(256)}
        self.halves: list[tuple[int, int]] = []
        for a, b in merges:
            pair = (self.token[raw[a]], self.token[raw[b]])
            self.rank[pair] = len(self.halves)
            self.token[raw[a] + raw[b]] = len(self.halves)
            self.halves.append(pair)
        self.longest = max(map(len, self.token))
        self.apart: dict[tuple[int, int], bool] = {}
        self.total: dict[str, int] = {}
        for text, name in list(self.token.items()):  # a token its own bytes don't encode to can't stand anywhere
            if name >= 0 and not self.stays_apart(*self.halves[name], below=name):
                del self.token[text]

    def stays_apart(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether encoding the bytes of a and b together leaves both as they are (or, below a rank, until it).

        The pieces next to the border are the right ends of a and the left ends of b, each there from the merge that
        made it to the merge that takes it in. They merge across the border if that merge's turn comes while both are
        there; of equal merges the left one goes first.
        """
        end = len(self.halves) if below is None else below
        left, right = [(a, end)], [(b, end)]
        while left[-1][0] >= 0:
            left.append((self.halves[left[-1][0]][1], left[-1][0]))
        while right[-1][0] >= 0:
            right.append((self.halves[right[-1][0]][0], right[-1][0]))
        for x, x_gone in left:
            for y, y_gone in right:
                m = self.rank.get((x, y))
                if m is not None and max(x, y) < m < x_gone and (m < y_gone or m == y_gone != end):
                    return False
        return True

    def inner(self, piece: bytes) -> list[int]:
        """Tokens of piece[:i] for i = 0 .. len(piece)."""
        count, last = [0], [None]
        token, apart = self.token, self.apart
        for i in range(1, len(piece) + 1):
            for j in range(max(0, i - self.longest), i):
                name = token.get(piece[j:i])
                if name is None:
                    continue
                before = last[j]
                if before is not None:
                    pair = (before, name)
                    ok = apart.get(pair)
                    if ok is None:
                        if len(apart) > 2 * MEMO_UNITS:
                            apart.clear()
                        ok = apart[pair] = self.stays_apart(before, name)
                    if not ok:
                        continue
                count.append(count[j] + 1)
                last.append(name)
                break
        return count

    def unit(self, unit: str) -> int:
        """Tokens of a unit."""
        return sum(self.inner(p.encode())[-1] for p in self.pieces(unit))

    def unit_prefixes(self, unit: str) -> list[int]:
        """Tokens of unit[:i] for i = 1 .. len(unit), code points."""
        out: list[int] = []
        blank = len(unit) - len(unit.lstrip())
        if blank > 1 or blank == len(unit):  # a cut inside the white space leaves one piece
            head = self.inner(unit[: blank or None].encode())
            out = [head[len(unit[:i].encode())] for i in range(1, blank + 1)]
        base = at = 0
        for piece in self.pieces(unit):
            counts = self.inner(piece.encode())
            size = 0
            short = len(piece) > 2 and piece[0] == "'" and piece[1:].isalpha()  # 've cut short is ' and v
            for i, c in enumerate(piece, 1):
                size += len(c.encode())
                if at + i > len(out):
                    cut = short and 1 < i < len(piece)
                    out.append(base + (sum(self.inner(p.encode())[-1] for p in self.pieces(piece[:i])) if cut else counts[size]))
            base += counts[-1]
            at += len(piece)
        return out

    def parts(self, text: str) -> Iterator[str]:
        """The text between special strings, and None for each special string."""
        rest = text
        while True:
            found = [(rest.find(s), s) for s in self.specials if s in rest]
            if not found:
                yield rest
                return
            at, special = min(found)
            yield rest[:at]
            yield None
            rest = rest[at + len(special) :]

    def split(self, text: str) -> list[str | None]:
        """Units of a text; None is a special string. Joined again they are the text."""
        if not any(s in text for s in self.specials):
            return self.units(text)
        out: list[str | None] = []
        for part in self.parts(text):
            out += [None] if part is None else self.units(part)
        return out

    def counts(self, units: list[str | None]) -> np.ndarray:
        total = self.total
        if len(total) > MEMO_UNITS:  # the memo starts anew, which changes no result
            total.clear()
        for u in {u for u in units if u not in total}:
            total[u] = 1 if u is None else self.unit(u)
        return np.fromiter(map(total.__getitem__, units), np.int64, len(units))

    def within(self, units: list[str | None], counts: np.ndarray, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        upto = np.cumsum(counts)
        k = int(np.searchsorted(upto, budget, side="right"))
        size = sum(len(self.specials[0]) if u is None else len(u) for u in units[:k])
        if k < len(units) and units[k] is not None:
            base = int(upto[k - 1]) if k else 0
            fits = [i for i, c in enumerate(self.unit_prefixes(units[k]), 1) if base + c <= budget]
            size += max(fits, default=0)
        return size

    def prefixes(self, text: str) -> list[int]:
        """Tokens of text[:i] for i = 1 .. len(text), for a text without special strings."""
        out: list[int] = []
        base = 0
        for unit in self.units(text):
            inside = self.unit_prefixes(unit)
            out += [base + c for c in inside]
            base += inside[-1]
        return out


def prefix_counts(name: str) -> PrefixCounts:
    import public_tokenizers

    state = worker_state()
    path = public_tokenizers.path(name)
    if path not in state:
        state[path] = PrefixCounts(path)
    return state[path]


def _count(vocabulary: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_counts(vocabulary)
        for batch in slices(batches, 1):
            names, sizes, totals, within = batch.column(0), [], [], []
            for text in batch.column(1).to_pylist():
                units = table.split(text)
                counts = table.counts(units)
                n = int(counts.sum())
                sizes.append(len(text.encode()))
                totals.append(n)
                within.append(len(text) if n <= limit else table.within(units, counts, limit))
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(within, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "chars_within"],
            )

    return run


def token_counts(docs: DataFrame, limit: int = 1024, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, chars_within (code points of the longest prefix within the limit).

    Null text counts as empty: 0 tokens. Repeated rows give a row each, an empty table none. Special strings inside a
    text count as one token, as the library has it by default. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    counted = rows.mapInArrow(_count(vocabulary, limit), "doc_id long, n_bytes long, n_tokens long, chars_within long")
    return counted.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "chars_within"
    )
