"""Benchmark passages in documents: latent semantic retrieval, then word-by-word checks.

1. Encoding. One pass over all texts turns words into codes: a word of the benchmark has its own, any other word one of
   ``other`` hashed ones. The codes are kept in a table (two or four bytes a word); nothing reads a text again. The pass
   also counts, for every code, the passages of 32 words that hold it.
2. Latent space. TF-IDF vectors of passages, over all codes, are the rows of a matrix A. A second pass adds up the sketch
   A'(A R) for a random R in the tasks; it is additive, and has a row per code. From it the driver takes a randomised
   eigendecomposition of A'A (Nystroem's: Z = A'AR, R'Z = LL', Z L^-T = U S V'), cut to ``rank``. Statistics, space and
   search are all of every passage.
   Neither items nor their directions are added, so words that are used alike fall together and rare words fade.
3. Search. A third pass, over the codes, projects every passage (two blocks of 16 words, one block on each time) on U
   and compares it with every item, and with every 32 words of long items, by cosine; a passage near an item needs
   ``own`` of its words as well. As rare words are faint in the space, pairs are found by words too: a text near an item that has ``close`` of its words has some of its
   rarest ones (as many as are left when the others are missing), and needs a few of them close by.
4. Check. For each candidate the longest common subsequence of words between the item and the text around the passage
   is taken. Most of the item in order is a leak; a good part of it is one if the item's answer (its last words) is
   there as well. For candidates of the latent search a word may also stand for its nearest neighbours in the latent
   space, if enough of the item's own words and its answer are there: so paraphrases with words used alike are found.

Tasks hold the code table's bounds, the basis (codes x rank) and a block of items; the driver holds the benchmark and
the basis.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import KEY, keyed, slices
from vitalgrid.llm.shingles import mixed, word_hashes
from vitalgrid.session import materialize

HALF = 16
SEED = 20240601


@dataclass(frozen=True)
class Settings:
    """Least ``cosine`` of a latent candidate; shares of an item's words in common order that make a leak alone
    (``same``) or with the answer (``close``); words of the ``answer`` and the share of them asked for.

    A paraphrase needs ``same`` of the item with alike words counted, ``own`` of its own words, and the answer; a word has
    at most ``alike`` such neighbours, with a cosine of ``alike_cosine`` or more and at least ``seen`` passages each.
    Size of the latent space (``rank``, and ``extra`` directions that the sketch has and the space has not), passages that a
    task adds to the sketch at a time (``fit``, a bound of memory; all of them take part), hashed codes (``other``), words that call for a check (``hits``) and items searched in one pass over the codes (``block``)."""

    cosine: float = 0.95
    same: float = 0.8
    close: float = 0.6
    answer: int = 5
    answer_share: float = 0.6
    own: float = 0.4
    alike: int = 2
    alike_cosine: float = 0.9
    seen: int = 5
    rank: int = 64
    extra: int = 8
    fit: int = 1 << 14
    other: int = 1 << 13
    hits: int = 3
    block: int = 2048


class Vocabulary:
    """Words of the benchmark items, by hash, and a table that finds them."""

    def __init__(self, items: list[np.ndarray], bits: int = 20):
        self.words = np.unique(np.concatenate([*items, np.zeros(0, np.uint64)]))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.words, np.arange((1 << bits) + 1, dtype=np.uint64) << self.shift).astype(np.int32)
        self.first[-1] = len(self.words)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, -1 if it isn't there."""
        slot = (hashes >> self.shift).astype(np.int64)
        low, high = self.first[slot], self.first[slot + 1]
        out = np.full(len(hashes), -1, np.int32)
        step = 0
        live = np.flatnonzero(low < high)
        while len(live):
            at = low[live] + step
            hit = self.words[at] == hashes[live]
            out[live[hit]] = at[hit]
            step += 1
            live = live[~hit & (at + 1 < high[live])]
        return out


def blocks_of(first: np.ndarray, width: int = HALF) -> tuple[np.ndarray, np.ndarray]:
    """Block of each word, ``width`` words side by side, and the first block of each text (one more at the end)."""
    sizes = np.diff(first)
    start = np.concatenate([[0], np.cumsum(-(-sizes // width))])
    inside = np.arange(int(sizes.sum())) - np.repeat(first[:-1] - first[0], sizes)
    return np.repeat(start[:-1], sizes) + inside // width, start


def row_sums(rows: np.ndarray, codes: np.ndarray, block: np.ndarray, n: int, width: int) -> np.ndarray:
    """Sums of the codes' rows by ascending block of at most ``width`` codes, n blocks. The last row is nought."""
    table = np.full((n, width), len(rows) - 1, np.int64)
    if len(codes):
        starts = np.concatenate([[True], block[1:] != block[:-1]])
        table[block, np.arange(len(block)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]] = codes
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    for low in range(0, n, 2048):  # small enough to stay in the cache
        part, total = table[low : low + 2048], out[low : low + 2048]
        some = np.empty_like(total)
        for k in range(width):
            np.take(rows, part[:, k], axis=0, out=some, mode="clip")
            total += some
    return out


def with_nought(rows: np.ndarray) -> np.ndarray:
    return np.vstack([rows, np.zeros((1, rows.shape[1]))]).astype(np.float32)


def common_subsequence(item_masks: dict[int, int], words: list[int]) -> int:
    """Length of the longest common subsequence, bits of the item's words advancing together."""
    row = 0
    for w in words:
        held = row | item_masks.get(w, 0)
        row = held & ~(held - (row << 1 | 1))
    return row.bit_count()


# ---- encoding ----

ENCODED = "kind int, doc_id long, __id long, __h long, codes binary, key long, n long"


def code_type(codes: int) -> str:
    return "<u2" if codes <= 1 << 16 else "<u4"


def _encode(vocabulary: Vocabulary, other: int):
    """For mapInArrow over (doc_id, text, __id, __h): the codes of each text (kind 0), and for each code the number of
    passages with it (1), of all passages (2)."""
    known = len(vocabulary.words)
    width = known + other
    kind = code_type(width)

    def rows(kinds: int, keys: list, counts: list) -> pa.RecordBatch:
        n = len(keys)
        none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        columns = [pa.array([kinds] * n, pa.int32()), *none, pa.array(keys, pa.int64()), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "doc_id", "__id", "__h", "codes", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(width, np.int64), 0
        for batch in slices(batches, 1, 1 << 20):
            hashes, first = word_hashes(batch.column(1), plain=True)
            found = vocabulary.find(hashes)
            codes = np.where(found >= 0, found, known + (mixed(hashes) % np.uint64(other)).astype(np.int64))
            passage, start = blocks_of(first, 2 * HALF)
            total += int(start[-1])
            held = np.unique(passage * width + codes)
            counts += np.bincount(held % width, minlength=width)
            flat = codes.astype(kind).tobytes()
            size = np.dtype(kind).itemsize
            offsets = (first * size).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(batch.num_rows, np.int32)),
                    batch.column(0),
                    batch.column(2),
                    batch.column(3),
                    pa.array([flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()),
                    pa.nulls(batch.num_rows, pa.int64()),
                    pa.nulls(batch.num_rows, pa.int64()),
                ],
                names=["kind", "doc_id", "__id", "__h", "codes", "key", "n"],
            )
        some = np.flatnonzero(counts)
        yield rows(1, some.tolist(), counts[some].tolist())
        yield rows(2, [0], [total])

    return run


def _decoded(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All codes of a batch and each text's first."""
    texts = column.to_pylist()
    size = np.dtype(kind).itemsize
    first = np.concatenate([[0], np.cumsum([len(t) // size for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), kind).astype(np.int64), first


# ---- latent space ----


def random_rows(codes: int, wide: int) -> np.ndarray:
    """R, the same wherever it is made: tasks make their own and are sent nothing."""
    return np.random.default_rng(SEED).standard_normal((codes, wide), np.float32)


def _sketch(idf: np.ndarray, wide: int, kind: str, step: int):
    """For mapInArrow over (codes): the rows of A'(A R), R one random row for each code, passages of unit length.

    All passages take part, ``step`` at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = with_nought(idf[:, None] * random_rows(len(idf), wide))
        total = np.zeros((len(idf), wide), np.float64)
        for batch in slices(batches, 0, 1 << 19):
            all_codes, first = _decoded(batch.column(0), kind)
            if not len(all_codes):
                continue
            of, start = blocks_of(first, 2 * HALF)
            for low in range(0, int(start[-1]), step):
                a, b = np.searchsorted(of, [low, low + step])
                codes, passage = all_codes[a:b], of[a:b] - low
                n = int(passage[-1]) + 1
                square = np.bincount(passage, weights=idf[codes] ** 2, minlength=n)
                image = row_sums(weighted, codes, passage, n, 2 * HALF) / np.maximum(square, 1e-9)[:, None].astype(np.float32)
                # words by code, a code's first summed in blocks as the passages' were
                order = np.argsort(codes.astype(kind), kind="stable")
                own = codes[order]
                starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                block, first_block = blocks_of(np.append(starts, len(own)))
                sums = row_sums(with_nought(image), passage[order], block, int(first_block[-1]), HALF)
                total[own[starts]] += np.add.reduceat(sums, first_block[:-1], axis=0) * idf[own[starts], None]
        some = np.flatnonzero(total.any(axis=1))
        columns = [pa.array(some)] + [pa.array(total[some, j]) for j in range(total.shape[1])]
        yield pa.RecordBatch.from_arrays(columns, names=["code", *[f"z{j}" for j in range(total.shape[1])]])

    return run


def latent_basis(encoded: DataFrame, idf: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvectors of A'A (codes x rank) over all passages, and the roots of their eigenvalues."""
    wide = settings.rank + settings.extra
    names = [f"z{j}" for j in range(wide)]
    schema = "code long, " + ", ".join(f"{z} double" for z in names)
    run = _sketch(idf, wide, code_type(len(idf)), settings.fit)
    parts = encoded.where("kind = 0").select("codes").mapInArrow(run, schema)
    rows = parts.groupBy("code").agg(*[F.sum(z).alias(z) for z in names]).toArrow()  # one row per code
    sketch, at = np.zeros((len(idf), wide)), rows.column("code").to_numpy()
    for j, z in enumerate(names):
        sketch[at, j] = rows.column(z).to_numpy()
    del rows
    small = random_rows(len(idf), wide).T.astype(float) @ sketch
    value, vector = np.linalg.eigh((small + small.T) / 2)
    keep = value > max(value.max(initial=0), 1e-300) * 1e-10
    out, root = np.zeros((len(idf), settings.rank)), np.zeros(settings.rank)
    if keep.any():
        left, found, _ = np.linalg.svd(sketch @ (vector[:, keep] / np.sqrt(value[keep])), full_matrices=False)
        size = min(settings.rank, int((found > 0).sum()))
        out[:, :size], root[:size] = left[:, :size], found[:size]
    return out, root


def alike_words(basis: np.ndarray, counts: np.ndarray, known: int, settings: Settings) -> list[list[int]]:
    """For each benchmark word the few codes that are used most like it, itself apart."""
    length = np.linalg.norm(basis, axis=1)
    sure = np.flatnonzero((counts >= settings.seen) & (length > 0))
    unit = (basis[sure] / length[sure, None]).astype(np.float32)
    out: list[list[int]] = [[] for _ in range(known)]
    ask = np.flatnonzero(sure < known)
    for start in range(0, len(ask), 32):  # a few rows at a time: the driver holds 32 x codes
        some = ask[start : start + 32]
        near = unit[some] @ unit.T
        near[np.arange(len(some)), some] = -1
        for i, row in enumerate(near):
            best = np.flatnonzero(row >= settings.alike_cosine)
            best = best[np.argsort(-row[best], kind="stable")[: settings.alike]]
            out[int(sure[some[i]])] = sure[best].tolist()
    return out


# ---- search ----


def pieces(n: int) -> list[tuple[int, int]]:
    """Parts of an item of n words that passages are compared with: the whole, and if it is longer than a passage
    every passage of it, the last one flush with its end."""
    whole = 2 * HALF
    return [(0, n)] + ([(i, i + whole) for i in range(0, n - whole, HALF)] + [(n - whole, n)] if n > whole else [])


@dataclass
class Index:
    """What tasks hold of a block of items.

    ``vectors`` are unit vectors of the items' pieces, ``owner`` their items, ``held`` the sorted pairs of piece and word
    (piece x codes + word) and ``sizes`` the pieces' distinct words. ``called`` lists, for every benchmark word,
    from ``first`` on, the items of which it is one of the rare words; ``asked`` is the hits an item asks for.
    """

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    owner: np.ndarray
    held: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    called: np.ndarray
    asked: np.ndarray
    names: list[int]
    items: list[list[int]]
    alike: list[list[int]]
    settings: Settings


def rare_words(item: np.ndarray, counts: np.ndarray, settings: Settings) -> tuple[np.ndarray, int]:
    """Distinct rare words of an item, and how many occurrences a text with ``close`` of its words has of them.

    Such a text misses at most n - t of n word places, t of them needed: of any n - t + j places it has j or more.
    """
    need = max(1, int(np.ceil(min(settings.same, settings.close) * len(item) - 1e-9)))
    hits = min(settings.hits, need)
    order = np.lexsort((item, counts[item]))
    return np.unique(item[order[: len(item) - need + hits]]), hits


def build_index(items: list[tuple[int, np.ndarray]], counts: np.ndarray, idf: np.ndarray, basis: np.ndarray, known: int, alike: list[list[int]], settings: Settings) -> Index:
    projection = with_nought(idf[:, None] * basis)
    vectors, owner, held, sizes, words, called, asked = [], [], [], [], [], [], []
    for k, (_, item) in enumerate(items):
        for a, b in pieces(len(item)):
            kinds = np.unique(item[a:b])
            held.append(len(owner) * len(counts) + kinds)
            sizes.append(len(kinds))
            vectors.append(projection[item[a:b]].sum(axis=0))
            owner.append(k)
        rare, hits = rare_words(item, counts, settings)
        words.append(rare)
        called.append(np.full(len(rare), k))
        asked.append(hits)
    v = np.array(vectors, np.float32)
    length = np.linalg.norm(v, axis=1, keepdims=True)
    word, owners = np.concatenate(words), np.concatenate(called)
    order = np.argsort(word, kind="stable")
    first = np.searchsorted(word[order], np.arange(known + 1))
    return Index(
        idf, projection, np.divide(v, length, out=np.zeros_like(v), where=length > 0), np.array(owner),
        np.concatenate(held), np.array(sizes), first, owners[order],
        np.array(asked), [n for n, _ in items], [w.tolist() for _, w in items], alike, settings,
    )


class Checker:
    """Word-by-word checks of items in texts."""

    def __init__(self, index: Index) -> None:
        self.index, self.s = index, index.settings
        self.masks: dict[tuple[int, bool], dict[int, int]] = {}

    def mask(self, k: int, soft: bool) -> dict[int, int]:
        """Word to its places in item k; with ``soft`` also of the words used like it."""
        if (k, soft) not in self.masks:
            out: dict[int, int] = {}
            for i, w in enumerate(self.index.items[k]):
                for x in [w, *(self.index.alike[w] if soft else [])]:
                    out[x] = out.get(x, 0) | 1 << i
            self.masks[k, soft] = out
        return self.masks[k, soft]

    def _share(self, around: list[int], k: int, soft: bool, least: float) -> float:
        """Share of the item's words in common order; 0 if too few occur at all."""
        mask, n = self.mask(k, soft), len(self.index.items[k])
        cover = 0
        for w in mask.keys() & set(around):
            cover |= mask[w]
        if cover.bit_count() < least * n:
            return 0.0
        return common_subsequence(mask, [w for w in around if w in mask]) / n

    def common(self, words: np.ndarray, middle: int, k: int, latent: bool) -> float:
        """Common share of item k with the text around a word, 0 if it isn't a leak."""
        s, item = self.s, self.index.items[k]
        around = words[max(0, middle - HALF - len(item)) : middle + HALF + len(item)].tolist()
        tail, there = item[-s.answer :], set(around)
        share = self._share(around, k, False, min(s.same, s.close))
        if share >= s.same or (share >= s.close and sum(w in there for w in tail) >= s.answer_share * len(tail)):
            return share
        if not latent:
            return 0.0
        own = self._share(around, k, False, s.own)
        if own < s.own:
            return 0.0
        share = self._share(around, k, True, s.same)
        said = sum(w in there or any(x in there for x in self.index.alike[w]) for w in tail)
        return share if share >= s.same and said >= s.answer_share * len(tail) else 0.0


def _by_words(index: Index, codes: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """For (text, item): (hits, place) of the places on a grid of 16 words around which enough rare words are."""
    known = len(index.first) - 1
    at = np.flatnonzero(codes < known)
    sizes = index.first[codes[at] + 1] - index.first[codes[at]]
    at, sizes = at[sizes > 0], sizes[sizes > 0]
    if not len(at):
        return {}
    take = np.repeat(index.first[codes[at]] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    item, place = index.called[take], np.repeat(at, sizes)
    text = np.searchsorted(first, place, side="right") - 1
    # a first count over the whole text: most texts have too few rare words of most items
    pair = text * len(index.items) + item
    kinds, back, n = np.unique(pair, return_inverse=True, return_counts=True)
    enough = (n >= index.asked[kinds % len(index.items)])[back]
    item, place, text = item[enough], place[enough], text[enough]
    if not len(item):
        return {}
    length = np.array([len(w) for w in index.items])[item]
    inside = place - first[text]
    low = np.maximum(0, -((-(inside - HALF - length + 1)) // HALF))
    high = np.minimum((inside + HALF + length) // HALF, (first[text + 1] - first[text] - 1) // HALF + 1)
    spread = np.maximum(high - low + 1, 0)
    grid = np.repeat(low - np.cumsum(spread) + spread, spread) + np.arange(int(spread.sum()))
    most = int(grid.max(initial=0)) + 1
    cell = (np.repeat(text, spread) * len(index.items) + np.repeat(item, spread)) * most + grid
    cells, n = np.unique(cell, return_counts=True)
    pair = cells // most
    good = n >= index.asked[pair % len(index.items)]
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for p, g, c in zip(pair[good].tolist(), (cells[good] % most).tolist(), n[good].tolist(), strict=True):
        out.setdefault((p // len(index.items), p % len(index.items)), []).append((c, g * HALF))
    return out


def _by_cosine(index: Index, codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(text, item, place, cosine) of the passages near an item in the latent space."""
    block, start = blocks_of(first)
    size = int(start[-1])
    image = row_sums(index.projection, codes, block, size, HALF)
    last = np.zeros(size, bool)
    last[start[1:][np.diff(start) > 0] - 1] = True
    inner = np.append(~last[:-1], False)
    image[:-1] = image[:-1] + np.where(inner[:-1, None], image[1:], 0)  # a passage is a block and its successor
    text = np.searchsorted(start, np.arange(size), side="right") - 1
    ask = np.flatnonzero(inner | (np.diff(start) == 1)[text])
    length = np.linalg.norm(image, axis=1)
    begin = np.searchsorted(block, np.arange(size + 1))
    step = max(1, (1 << 21) // max(1, len(index.owner)))
    for lo in range(0, len(ask), step):
        some = ask[lo : lo + step]
        near = (image[some] / np.maximum(length[some, None], 1e-9)) @ index.vectors.T
        i, v = np.nonzero(near >= index.settings.cosine)
        cosine = near[i, v]
        at = some[i]
        # of the words of each pair's passage, those that the piece has
        low, high = begin[at], begin[at + 1 + inner[at]]
        n = high - low
        pair = np.repeat(np.arange(len(at)), n)
        words = codes[np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        wanted = v[pair] * len(index.idf) + words
        place = np.minimum(np.searchsorted(index.held, wanted), len(index.held) - 1)
        own = np.unique((pair * (1 << 32) + words)[index.held[place] == wanted])
        enough = np.bincount(own >> 32, minlength=len(at)) >= index.settings.own * index.sizes[v]
        for a, k, c in zip(at[enough].tolist(), index.owner[v[enough]].tolist(), cosine[enough].tolist(), strict=True):
            t = int(text[a])
            yield t, k, (a - int(start[t]) + 1) * HALF, c


def _search(index: Index, kind: str):
    """For mapInArrow over (codes, doc_id, __id, __h): confirmed pairs with their latent cosine and common share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checker = Checker(index)
        for batch in slices(batches, 0, 1 << 19):
            codes, first = _decoded(batch.column(0), kind)
            if not len(codes):
                continue
            near: dict[tuple[int, int], dict[int, float]] = {}
            for t, k, place, cosine in _by_cosine(index, codes, first):
                places = near.setdefault((t, k), {})
                places[place] = max(cosine, places.get(place, 0.0))
            words = _by_words(index, codes, first)
            out = []
            for t, k in sorted(near.keys() | words.keys()):
                text, best = codes[first[t] : first[t + 1]], 0.0
                for place in near.get((t, k), {}):
                    best = max(best, checker.common(text, place, k, True))
                for _, place in sorted(words.get((t, k), []), reverse=True):
                    if best >= index.settings.same:
                        break
                    best = max(best, checker.common(text, place, k, False))
                if best:
                    out.append((t, k, max(near.get((t, k), {}).values(), default=0.0), best))
            if out:
                names, ids, hs = (batch.column(i).to_pylist() for i in (1, 2, 3))
                rows = [(names[t], ids[t], hs[t], index.names[k], c, x) for t, k, c, x in out]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["doc_id", "__id", "__h", "item_id", "cosine", "common"],
                )

    return run


LEAK = "doc_id long, __id long, __h long, item_id long, cosine double, common double"


def _leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings) -> DataFrame:
    spark = docs.sparkSession
    rows = [(r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").collect()]
    hashes, first = word_hashes(pa.array([t for _, t in rows], pa.string()), plain=True)
    words = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    kept = [i for i, w in enumerate(words) if len(w)]
    if not kept:
        return spark.createDataFrame([], LEAK)
    vocabulary = Vocabulary([words[i] for i in kept])
    known = len(vocabulary.words)
    kind = code_type(known + settings.other)
    texts = keyed(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *KEY)
    encoded = materialize(texts.mapInArrow(_encode(vocabulary, settings.other), ENCODED), "codes")
    counts = np.zeros(known + settings.other, np.int64)
    for r in encoded.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).collect():  # one per code
        counts[r["key"]] = r["n"]
    passages = encoded.where("kind = 2").agg(F.sum("n").alias("n")).first()["n"] or 0
    idf = np.log((passages + 1) / (counts + 1)) + 0.01
    basis, root = latent_basis(encoded, idf, settings)
    alike = alike_words(basis * root, counts, known, settings)
    items = [(rows[i][0], vocabulary.find(words[i]).astype(np.int64)) for i in kept]
    out = None
    for start in range(0, len(items), settings.block):
        index = build_index(items[start : start + settings.block], counts, idf, basis, known, alike, settings)
        given = encoded.where("kind = 0").select("codes", "doc_id", *KEY)
        part = given.mapInArrow(_search(index, kind), LEAK)
        out = part if out is None else out.unionByName(part)
    return out


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row per document and benchmark item found in it: doc_id, item_id, cosine (in the latent space; 0 if only words
    brought the pair up) and common.

    Null, empty or blank texts hold and are nothing. Equal items are found each. Rows equal in doc_id and text give
    equal rows. Empty tables: no rows. A very long text is encoded once and searched as one row of codes. Other columns
    are ignored, whatever their names.
    """
    return _leaks(docs, benchmark, settings).select("doc_id", "item_id", "cosine", "common")


def without_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents in which no item was found, all their columns kept; names after two underscores are reserved.

    Null, empty and blank texts stay, rows equal in doc_id and text stay or go together, empty tables change nothing.
    """
    found = materialize(_leaks(docs, benchmark, settings).select(*KEY).distinct(), "leaks")
    return keyed(docs).join(found, KEY, "left_anti").select(*docs.columns)
