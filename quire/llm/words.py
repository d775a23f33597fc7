"""Hashes of words: one at a time, remembered by each Python worker, or of many texts at once, as array operations."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

MAX_WORDS = 300_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        out = self[word] = xxh64_intdigest(word)
        return out


#: word in UTF-8 -> its 64-bit hash; cleared when full
HASHES = _Hashes()

_LOWER = bytes(32 if c in b" \t\n\r\x0b\x0c" else c + 32 if 65 <= c <= 90 else c for c in range(256))
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONG = 64  # bytes; longer words are hashed one at a time


def placed(data: bytes, space: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs between spaces in data, which begins and ends with one."""
    edges = np.flatnonzero(np.diff(np.frombuffer(data, np.uint8) == space)) + 1
    return edges[::2], edges[1::2] - edges[::2]


def eights(data: bytes) -> np.ndarray:
    """The eight bytes from each place of data on, as numbers."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts joined end to end, A-Z lower-cased, and the number of words of each text.

    Words are runs without ASCII white space. Eight bytes of every word are mixed in at a time, so equal words have equal
    hashes wherever they stand. They are not those of HASHES.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = b"".join([b" ", b" ".join(texts).translate(_LOWER), b" " * 9])
    start, n = placed(data)
    eight = eights(data)
    h = n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rest, at, left = slice(None), start, n
    while len(at):
        x = (eight[at] & MASKS[np.minimum(left, 8)]) ^ h[rest]
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        h[rest] = x ^ x >> np.uint64(32)
        more = np.flatnonzero((left > 8) & (left <= _LONG))
        rest = more if isinstance(rest, slice) else rest[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(n > _LONG):
        h[i] = xxh64_intdigest(data[start[i] : start[i] + n[i]])
    ends = 1 + np.cumsum(size + 1)  # a text's words begin before the place behind it
    return h, np.diff(np.searchsorted(start, ends), prepend=0)
