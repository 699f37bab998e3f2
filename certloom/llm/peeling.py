"""Immutable fingerprint filter built by peeling a random 3-uniform hypergraph (an xor filter).

1.23 slots a key plus a constant; no false negatives; one false positive in 2**bits.
Building and probing are whole-array numpy operations.
"""

import numpy as np

from certloom.llm.mixing64 import mix, reduce_to

_U = np.uint64


class PeelingFilter:
    """Filter over distinct uint64 keys. ``keys`` may repeat; an empty filter contains nothing."""

    def __init__(self, keys: np.ndarray, bits: int = 16):
        if bits not in (8, 16, 32):
            raise ValueError("bits must be 8, 16 or 32")
        self.bits = bits
        keys = np.unique(np.asarray(keys, dtype=np.uint64))
        self.n = len(keys)
        self.third = 0
        self.seed = 0
        self.slots = np.zeros(0, dtype=f"u{bits // 8}")
        if self.n:
            self.third = int(np.ceil((1.23 * self.n + 32) / 3))
            while not self._build(keys):  # each try succeeds with a probability near 1
                self.seed += 1
                if self.seed % 16 == 0:
                    self.third += self.third // 50 + 1

    @classmethod
    def opened(cls, n: int, third: int, seed: int, bits: int, slots: bytes) -> "PeelingFilter":
        """A stored filter."""
        f = cls(np.zeros(0, np.uint64), bits)
        f.n, f.third, f.seed, f.slots = n, third, seed, np.frombuffer(slots, dtype=f"<u{bits // 8}")
        return f

    def _places(self, keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        z = mix(keys, self.seed)
        at = [reduce_to(mix(z, k + 1), self.third).astype(np.int64) + k * self.third for k in range(3)]
        return at, mix(z, 7).astype(self.slots.dtype)

    def _build(self, keys: np.ndarray) -> bool:
        at, prints = self._places(keys)
        size = 3 * self.third
        degree = np.zeros(size, dtype=np.int32)
        held = np.zeros(size, dtype=np.int64)  # xor of the keys' indices at a slot
        for a in at:
            degree += np.bincount(a, minlength=size).astype(np.int32)
            np.bitwise_xor.at(held, a, np.arange(self.n, dtype=np.int64))
        order: list[tuple[np.ndarray, np.ndarray]] = []
        free, left = np.flatnonzero(degree == 1), self.n
        while len(free):
            key, first = np.unique(held[free], return_index=True)  # one free slot for each key
            slot = free[first]
            order.append((key, slot))
            left -= len(key)
            touched = []
            for a in at:
                s = a[key]
                np.subtract.at(degree, s, 1)
                np.bitwise_xor.at(held, s, key)
                touched.append(s)
            near = np.unique(np.concatenate(touched))
            free = near[degree[near] == 1]
        if left:
            return False
        table = np.zeros(size, dtype=f"u{self.bits // 8}")
        for key, slot in reversed(order):
            rest = prints[key].copy()
            for a in at:
                s = a[key]
                rest ^= np.where(s == slot, table.dtype.type(0), table[s])
            table[slot] = rest
        self.slots = table
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, dtype=np.uint64)
        if not self.n:
            return np.zeros(len(keys), dtype=bool)
        at, prints = self._places(keys)
        return prints == (self.slots[at[0]] ^ self.slots[at[1]] ^ self.slots[at[2]])

    @property
    def false_positive_rate(self) -> float:
        return 2.0**-self.bits if self.n else 0.0

    @property
    def nbytes(self) -> int:
        return self.slots.nbytes
