"""Token ids of whole texts for a word-level byte-pair vocabulary, each distinct word encoded once.

The vocabulary lower-cases, drops white space and never joins what white space parts, so a text's ids are the ids
of its space-separated words in order. Words are memoised for the life of a Python worker; the library encodes the
words not seen yet. Texts outside the plain alphabet below, and texts that hold a special string, go to the library
whole.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np

from vitalgrid.llm.common import worker_state

# The vocabulary file's special strings.
SPECIALS = ("<|startoftext|>", "<|endoftext|>")

# Characters whose case mapping, composition and classes are the same in every Unicode version.
UNSAFE = r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ž–—‘-„…]"

# Punctuation before a full stop or comma: there the two are one piece and stay together.
RUNS = r"[!-/:-@\[-`{-~¡-¬®-¿×÷–—‘-„…][.,]"

#: Words kept by a worker (about 200 MB), and words of letters that the library gets in one line.
MEMO_WORDS = 1_000_000
LINE_WORDS = 256


class WordIds:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.unsafe = re.compile(UNSAFE).search
        self.runs = re.compile(RUNS).search
        self.ids: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, words: set[str]) -> None:
        if len(self.ids) + len(words) > MEMO_WORDS:  # the memo starts anew, which changes no result
            self.ids = {}
        new = sorted(words)
        letters = [w for w in new if w.isalpha()]  # one piece each, so a line of them can be cut at word ends
        for i in range(0, len(letters), LINE_WORDS):
            part = letters[i : i + LINE_WORDS]
            line = np.frombuffer(self._library([" ".join(part)])[0], "<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[line]) + 1)).tolist()]
            raw = line.tobytes()
            self.ids.update(zip(part, (raw[x:y] for x, y in pairwise(cuts)), strict=True))
        other = [w for w in new if not w.isalpha()]
        self.ids.update(zip(other, self._library(other), strict=True))

    def plain(self, text: str) -> bool:
        return self.unsafe(text) is None and not ("<|" in text and any(s in text for s in SPECIALS))

    def words(self, text: str) -> list[str] | None:
        """Strings whose ids, one after the other, are the text's; full stops and commas stand alone."""
        if not self.plain(text):
            return None
        text = text.lower()
        if not self.runs(text):
            text = text.replace(".", " .").replace(",", " ,")
        return text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [self.words(text) for text in texts]
        known = self.ids.get
        found = [None if w is None else list(map(known, w)) for w in words]
        holes = []
        for k, ids in enumerate(found):
            i, n = -1, ids.count(None) if ids else 0
            for _ in range(n):
                i = ids.index(None, i + 1)
                holes.append((k, i))
        self._learn({words[k][i] for k, i in holes})
        for k, i in holes:
            found[k][i] = self.ids[words[k][i]]
        return [self._library([t])[0] if f is None else b"".join(f) for t, f in zip(texts, found, strict=True)]


def word_ids(name: str) -> WordIds:
    """The worker's own encoder for a vocabulary file."""
    import public_tokenizers

    state = worker_state()
    path = public_tokenizers.path(name)
    if path not in state:
        state[path] = WordIds(path)
    return state[path]
