"""FM-index over sequences of word numbers: suffix order, wavelet matrix, sampled positions.

All searches and locations run side by side in whole-array numpy steps. An index is a few byte strings
(``parts``), so it can be stored and opened again without the text.
"""

import numpy as np

_U = np.uint64
#: Ranks, group numbers and places of a suffix sort share one 64-bit key up to so many bits each.
_KEY_BITS = 21


def _heads(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], keys[1:] != keys[:-1]])


def _sorted_runs(major: np.ndarray, minor: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of its run) of rows by two numbers below 2**width."""
    n = len(major)
    if 3 * width <= 64:
        w = _U(width)
        keys = np.sort((((major.astype(_U) << w) | minor.astype(_U)) << w) | np.arange(n, dtype=_U))
        return (keys & _U((1 << width) - 1)).astype(np.int64), _heads(keys >> w)
    order = np.lexsort((minor, major))
    a, b = major[order], minor[order]
    return order, np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])


def suffix_order(tokens: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``tokens``; every 0 is a separator of its own, smaller than all words.

    Prefix doubling that sorts only what is still tied, starting from as many words as fit into one key.
    Ties end at a separator, so the number of rounds is the logarithm of the longest sequence, however
    often whole sequences repeat.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    width = n.bit_length()
    seps = tokens == 0
    symbol = np.where(seps, np.cumsum(seps) - 1, tokens.astype(np.int64) + int(seps.sum()))
    bits = max(int(symbol.max()).bit_length(), 1)
    k = (64 - width) // bits if width <= _KEY_BITS else 0
    if k >= 1:
        padded = np.concatenate([symbol.astype(_U), np.zeros(k, _U)])
        keys = np.zeros(n, _U)
        for i in range(k):
            keys = (keys << _U(bits)) | padded[i : i + n]
        keys = np.sort((keys << _U(width)) | np.arange(n, dtype=_U))
        sa, new = (keys & _U((1 << width) - 1)).astype(np.int64), _heads(keys >> _U(width))
    else:
        k, sa = 1, np.argsort(symbol, kind="stable")
        new = _heads(symbol[sa])
    rank = np.zeros(n + 1, dtype=np.int32 if n < 1 << 31 else np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    while len(tied):
        at = sa[tied]
        group = np.cumsum(_heads(rank[at])) - 1
        order, new = _sorted_runs(group, rank[np.minimum(at + k, n)], width)
        at = at[order]
        sa[tied] = at
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.concatenate([new[1:], [True]]))]
        k *= 2
    return sa


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit plane a level, with the ones before each 64-bit word of it."""

    def __init__(self, planes: list[np.ndarray], n: int):
        self.planes, self.n, self.levels = planes, n, len(planes)
        counts = [np.bitwise_count(p) for p in planes]
        self.before = [np.concatenate([[0], np.cumsum(c, dtype=np.int64)]) for c in counts]
        self.zeros = [n - int(b[-1]) for b in self.before]

    @classmethod
    def of(cls, symbols: np.ndarray, sigma: int) -> "WaveletMatrix":
        levels = max(int(sigma).bit_length(), 1)
        s = symbols.astype(np.uint16 if levels <= 16 else np.uint32)
        room = (len(s) // 64 + 1) * 8
        planes = []
        for level in range(levels - 1, -1, -1):
            bit = (s >> s.dtype.type(level)) & s.dtype.type(1) == 1
            packed = np.zeros(room, np.uint8)
            some = np.packbits(bit, bitorder="little")
            packed[: len(some)] = some
            planes.append(packed.view("<u8"))
            s = np.concatenate([s[~bit], s[bit]])
        return cls(planes, len(symbols))

    def _ones(self, level: int, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        low = (_U(1) << (place & 63).astype(_U)) - _U(1)
        return self.before[level][word] + np.bitwise_count(self.planes[level][word] & low)

    def walk(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            r = self._ones(k, place)
            place = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + r, place - r)
        return place

    def symbols(self, place: np.ndarray) -> np.ndarray:
        """What stands at the given places."""
        out = np.zeros(len(place), np.int64)
        for k in range(self.levels):
            bit = (self.planes[k][place >> 6] >> (place & 63).astype(_U)) & _U(1) == 1
            r = self._ones(k, place)
            place = np.where(bit, self.zeros[k] + r, place - r)
            out = out << 1 | bit
        return out


class FMIndex:
    """Index of one shard, made by ``of`` from word numbers 1..sigma, sequences ended by 0, or opened from ``parts``."""

    def __init__(self, n: int, levels: int, planes: bytes, counts: bytes, kept: bytes, position: bytes):
        self.n = n
        words = np.frombuffer(planes, "<u8").reshape(levels, -1)
        self.tree = WaveletMatrix(list(words), n)
        self.counts = np.frombuffer(counts, "<u4")
        self.before = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])[: len(self.counts)]
        self.kept = WaveletMatrix([np.frombuffer(kept, "<u8")], n)
        self.position = np.frombuffer(position, "<u4")

    @staticmethod
    def parts(tokens: np.ndarray, sigma: int, sample: int = 16) -> dict:
        """The arguments of the constructor: the stored form."""
        sa = suffix_order(tokens)
        bwt = tokens[sa - 1] if len(sa) else tokens
        tree = WaveletMatrix.of(bwt, sigma)
        # positions are kept at every sample-th place and at the start of each sequence, where no word precedes
        kept = (sa % sample == 0) | (bwt == 0)
        marks = WaveletMatrix.of(kept, 1)
        return {
            "n": len(tokens), "levels": tree.levels, "planes": b"".join(p.tobytes() for p in tree.planes), "counts": np.bincount(tokens, minlength=sigma + 1).astype("<u4").tobytes(),
            "kept": marks.planes[0].tobytes(), "position": sa[kept].astype("<u4").tobytes(),
        }

    @classmethod
    def of(cls, tokens: np.ndarray, sigma: int, sample: int = 16) -> "FMIndex":
        return cls(**cls.parts(tokens, sigma, sample))

    def _origin(self, symbol: np.ndarray) -> np.ndarray:
        some, at = np.unique(symbol, return_inverse=True)
        return (self.before[some] - self.tree.walk(some, np.zeros(len(some), dtype=np.int64)))[at]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows of equal length): the range [lo, hi) of suffixes of each."""
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            if not len(live):
                break
            c = phrases[live, k]
            origin = self._origin(c)
            lo[live], hi[live] = origin + self.tree.walk(c, lo[live]), origin + self.tree.walk(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in ``tokens`` of the given suffix rows, by steps back to the next kept position."""
        out = np.zeros(len(rows), dtype=np.int64)
        at, steps, live = rows.copy(), 0, np.arange(len(rows))
        while len(live):
            here = at[live]
            done = self.kept.symbols(here) == 1
            out[live[done]] = self.position[self.kept._ones(0, here[done])].astype(np.int64) + steps
            live, here = live[~done], here[~done]
            c = self.tree.symbols(here)
            at[live] = self._origin(c) + self.tree.walk(c, here)
            steps += 1
        return out
