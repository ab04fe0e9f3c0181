"""Shingle sets of whole texts, computed on Arrow buffers at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PARTS = _SPACE | np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))[_LOWER]


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have, step = 1, base
    while have < n:
        some = min(have, n - have)
        out[have : have + some] = out[:some] * np.uint64(step)
        have, step = have * 2, step * step % (1 << 64)
    return out


def word_hashes(texts: pa.Array, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased, white space is ASCII's) and each text's first word.

    A word's hash is a polynomial in its bytes, taken from running sums over the whole buffer; nulls have no words.
    ``plain`` parts words at ASCII punctuation as well and lower-cases Latin-1 capitals.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low = int(offsets[0])
    data, offsets = data[low : int(offsets[-1])], offsets - low
    n = len(data)
    if plain:
        data = data.copy()
        capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
        data[capital] += 0x20
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~(_PARTS if plain else _SPACE)[data]
    begin = inside[1:] & ~inside[:-1]
    end = ~inside[1:] & inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    edges = edges[inside[edges] & inside[edges + 1]]  # two texts that touch without white space
    begin[edges] = True
    end[edges] = True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    power = _powers(n + 1, _BASE)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:-1], out=total[1:])
    inverse = pow(_BASE, -1, 1 << 64)
    back = _powers(n + 1, inverse)
    hashes = mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, size: int = 3) -> list[np.ndarray]:
    """Each text's sorted distinct shingles of ``size`` words; with fewer words the whole sequence is one."""
    words, first = word_hashes(texts)
    run = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        run = run * np.uint64(_BASE) + words[k : len(words) - size + 1 + k]
    run = mixed(run)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(run[a : b - size + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = mixed(whole * np.uint64(_BASE) + words[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
