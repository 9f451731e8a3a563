"""Hash tables in numpy arrays, looked up for whole arrays of keys at once."""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)
_EMPTY = np.uint64(2**64 - 1)


class Table:
    """A hash table from 64-bit keys (not all ones) to 32-bit values: open addressing over two numpy arrays."""

    def __init__(self, bits: int):
        self.bits, self.used = bits, 0
        self.keys = np.full(1 << bits, _EMPTY, np.uint64)
        self.values = np.full(1 << bits, NONE, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put in distinct keys that are not there yet."""
        self.used += len(keys)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == _EMPTY
            self.keys[slot[todo[free]]] = keys[todo[free]]  # of several that want a slot the last one has it
            done = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[done]]] = values[todo[done]]
            todo = todo[~done]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; a large number where there is none."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        todo = np.flatnonzero((found != keys) & (found != _EMPTY))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found != _EMPTY)
            todo, slot = todo[on], slot[on]
        return out
