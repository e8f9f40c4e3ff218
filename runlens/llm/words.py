"""Terms of many texts at once: runs of ASCII letters and of all characters
beyond ASCII."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import utf8

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and where each starts (n + 1, from 0)."""
    offsets, data = utf8(texts)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if len(data) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that cut no term; a longer term makes a
    longer piece."""
    a, step = 0, 1 << 16
    while a < len(data):
        b = min(a + size, len(data))
        while b < len(data):
            out = np.flatnonzero(~_LETTER[data[b:b + step]])
            if len(out):
                b += int(out[0])
                break
            b = min(b + step, len(data))
        yield a, b
        a = b


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms in order, A-Z in lower case, and the text of each; no term
    goes over the end of a text."""
    letter = _LETTER[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[at] = letter[at]
    starts = np.flatnonzero(first)
    kept = _LOWER[data[letter]]
    before = np.cumsum(letter, dtype=np.int64)
    bounds = np.r_[before[starts] - 1, len(kept)].astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(kept))
    return found, np.searchsorted(offsets, starts, side="right") - 1
