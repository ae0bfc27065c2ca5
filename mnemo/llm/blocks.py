"""Hashes with their owners' ids, packed into one binary row per group for the shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd

SCHEMA = "p int, ids binary, sizes binary, hashes binary"


def deal(hashes: list[np.ndarray], ids: list[int], groups: int) -> dict[int, tuple[bytes, bytes, bytes]]:
    """Group -> (ids, hashes of each id, hashes): ``hashes[i]`` belong to ``ids[i]``.

    The group comes from the upper bits, the lower 48 bits of a hash are kept:
    hashes can only be equal by chance where a group holds far more than 2^24.
    """
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in hashes]) if hashes else np.zeros(0, np.int32)
    to = ((h >> np.uint64(40)).astype(np.int32) % np.int32(groups))  # 24 bits
    order = np.argsort(to, kind="stable")
    h, owner = h[order], owner[order]
    cuts = np.searchsorted(to[order], np.arange(groups + 1, dtype=np.int32))
    id_array, out = np.array(ids, np.int64), {}
    for p in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[p], cuts[p + 1]
        at = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
        out[int(p)] = (id_array[owner[a:b][at]].tobytes(), np.diff(np.append(at, b - a)).astype(np.int32).tobytes(),
                       h[a:b].view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
    return out


def gather(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one group: hashes in order with their ids, and the first and the end of every run of equal hashes."""
    ids = np.concatenate([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(k, np.int32)) for i, k in zip(pdf["ids"], pdf["sizes"])])
    raw = np.frombuffer(b"".join(pdf["hashes"]), np.uint8).reshape(-1, 6)
    h = np.zeros((len(raw), 8), np.uint8)
    h[:, :6] = raw
    h = h.view(np.uint64).ravel()
    order = np.argsort(h, kind="stable")
    h, ids = h[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h, ids, first, np.append(first[1:], len(h)).astype(np.int64) if len(h) else first
