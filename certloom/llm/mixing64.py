"""64-bit mixing of arrays, shared by the sketches and filters of this package."""

import numpy as np

_U = np.uint64


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """Finaliser of splitmix64, keyed by ``seed``; a bijection on uint64, the same on every machine."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64, copy=True)
        z += _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        z ^= z >> _U(30)
        z *= _U(0xBF58476D1CE4E5B9)
        z ^= z >> _U(27)
        z *= _U(0x94D049BB133111EB)
        z ^= z >> _U(31)
    return z


def reduce_to(z: np.ndarray, n: int) -> np.ndarray:
    """Maps the upper 32 bits of each value to 0..n-1 without division (n below 2**32)."""
    return ((z >> _U(32)) * _U(n)) >> _U(32)
