"""Words and word shingles of whole Arrow columns as numpy arrays, without a Python step for each word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE = 5
_CHUNK = 1 << 19
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a fixed bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the rolling hash and of its inverse, for at most 2 ** 20 + 1 positions."""
    if "p" not in _POWERS:
        size = 2 * _CHUNK + 1
        for name, base in (("p", BASE), ("i", BASE_INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[name] = np.multiply.accumulate(step)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts (null: empty) and the offsets of its rows in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most_bytes`` of text each; a longer row stands alone."""
    _, offsets = text_bytes(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        yield i, j
        i = j


class Words:
    """Words of some rows: ``start``/``end`` (byte positions), ``hash``, and ``first`` (of each row, with the total at the end)."""

    def __init__(self, texts: pa.Array):
        self.bytes, self.offsets = text_bytes(texts)
        solid = ~_SPACE[self.bytes]
        before = np.zeros(len(solid), bool)
        before[1:] = solid[:-1]
        edges = self.offsets[:-1][np.diff(self.offsets) > 0]
        before[edges] = False
        after = np.zeros(len(solid), bool)
        after[:-1] = solid[1:]
        after[(self.offsets[1:][np.diff(self.offsets) > 0]) - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        i, n = 0, len(self.start)
        while i < n:
            j = int(np.searchsorted(self.start, self.start[i] + _CHUNK, "left"))
            if self.end[j - 1] - self.start[i] > 2 * _CHUNK:
                if j - 1 == i:  # one giant word
                    out[i] = xxhash.xxh64_intdigest(self.bytes[self.start[i] : self.end[i]].tobytes())
                    i += 1
                    continue
                j -= 1
            a, b = self.start[i], self.end[j - 1]
            power, inverse = powers(b - a)
            total = np.empty(b - a + 1, np.uint64)
            total[0] = 0
            np.cumsum(_BYTE[self.bytes[a:b]] * power, out=total[1:])
            out[i:j] = (total[self.end[i:j] - a] - total[self.start[i:j] - a]) * inverse[self.start[i:j] - a]
            i = j
        return mix(out)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def shingles(self, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``k`` words of each row, and the first of each row. A row of fewer words (not none) has one."""
        counts = np.diff(self.first)
        full = np.maximum(counts - k + 1, 0)
        has = np.where(counts > 0, np.maximum(full, 1), 0)
        first = np.concatenate([[0], np.cumsum(has)])
        at = np.repeat(self.first[:-1] - first[:-1], has) + np.arange(first[-1])
        padded = np.concatenate([self.hash, np.zeros(k, np.uint64)])
        ends = np.repeat(self.first[1:], has)
        h = np.zeros(len(at), np.uint64)
        short = bool((has > full).any())
        for j in range(k):
            part = padded[at + j]
            if short:
                part = np.where(at + j < ends, part, np.uint64(0x51ED270B))
            h = h * np.uint64(BASE) + part
        return mix(h), first


def shingle_set(text: str | None, k: int = SHINGLE) -> set[tuple[str, ...]]:
    """The shingles of one text by plain Python, for tests and exact checks."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
