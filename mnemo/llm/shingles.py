"""Words and hashed word n-grams of whole texts, a text at a time."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

# A-Z to a-z, nothing else; bytes.split() then cuts at space and at 9 to 13
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Longer words stand for themselves by a digest, so that a slice of a text has a bounded number of bytes.
WORD_BYTES = 200
SLICE_WORDS = 20_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, from 0 to n at least."""
    if len(_POWERS[0]) <= n:
        size = 1 << (n + 1).bit_length()
        for i, b in enumerate((_BASE, _INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _POWERS[i] = np.cumprod(x)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits (64-bit finaliser)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | None, lower: bool = True) -> list[bytes]:
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    words = (data.translate(LOWER) if lower else data).split()
    if len(data) > WORD_BYTES:
        for i, w in enumerate(words):
            if len(w) > WORD_BYTES:
                words[i] = b"\0" + blake2b(w, digest_size=16).digest().hex().encode()
    return words


def spans_hash(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums of the words joined by spaces, and where each word starts and ends: see ``window_hash``."""
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][:len(data)], out=prefix[1:])
    return prefix, starts, ends


def window_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n words (none if there are fewer), the same wherever the window stands."""
    k = len(starts) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    s, e = starts[:k], ends[n - 1:]
    return mix((prefix[e] - prefix[s]) * powers(len(prefix))[1][s])


def shingles(words: list[bytes], n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word windows; fewer words are one window; none have none."""
    if not words:
        return np.zeros(0, np.uint64)
    n = min(n, len(words))
    parts = [window_hash(*spans_hash(words[i:i + SLICE_WORDS + n - 1]), n) for i in range(0, max(1, len(words) - n + 1), SLICE_WORDS)]
    return np.unique(np.concatenate(parts))
