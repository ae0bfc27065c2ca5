"""Per-word vectors, computed once for every distinct word that a worker meets."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np

#: Words remembered before the memo is emptied.
MEMO_WORDS = 300_000
#: Texts are taken together up to so many words.
BATCH_WORDS = 60_000


class WordRows:
    def __init__(self, vectors: Callable[[list[bytes]], np.ndarray], width: int):
        self.vectors, self.place = vectors, {}
        self.table = np.zeros((1024, width), np.float32)

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Row of every word in ``table``; rows stay valid until the next call."""
        new = set(words).difference(self.place)
        if len(self.place) + len(new) > MEMO_WORDS:
            self.place, new = {}, set(words)
        if new:
            fresh, n = list(new), len(self.place)
            if len(self.table) < n + len(fresh):
                grown = np.zeros((1 << (n + len(fresh) - 1).bit_length(), self.table.shape[1]), np.float32)
                grown[:n] = self.table[:n]  # rows not yet used take no memory
                self.table = grown
            for i in range(0, len(fresh), 20_000):
                part = fresh[i:i + 20_000]
                self.table[n + i:n + i + len(part)] = self.vectors(part)
            self.place.update(zip(fresh, range(n, n + len(fresh))))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))


def gram_ids(word: bytes, sizes: tuple[int, ...], buckets: int) -> list[int]:
    """Hash buckets of the byte n-grams of a word between boundary marks."""
    w = b"^" + word + b"$"
    return [crc32(w[i:i + n]) % buckets for n in sizes for i in range(len(w) - n + 1)]


def word_batches(texts: list[list[bytes]]) -> list[list[int]]:
    """Indices of texts in groups of about BATCH_WORDS words (a longer text is a group of its own)."""
    out, held = [[]], 0
    for i, t in enumerate(texts):
        if held and held + len(t) > BATCH_WORDS:
            out.append([])
            held = 0
        out[-1].append(i)
        held += len(t)
    return out
