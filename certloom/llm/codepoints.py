"""Texts of an Arrow batch exploded to one array of positioned code points, and back.

Position is the array index; ``bounds`` holds where each text begins. Nothing is parsed row by row.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in blocks of about so many bytes, so that memory does not follow the batch size.
BLOCK_BYTES = 2 << 20


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``block_bytes`` of text each; a longer text is a block of its own."""
    n = len(texts)
    if not n:
        return
    offsets = _offsets(texts)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + block_bytes, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def _offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type)
    return np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def explode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points as uint32, bounds as int64 of length n + 1). Null is an empty text."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    offsets = _offsets(texts)
    data = texts.buffers()[2]
    raw = b"" if data is None else data[offsets[0] : offsets[-1]].to_pybytes()
    cps = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(cps) == len(raw):
        return cps, offsets - offsets[0]
    lead = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(lead, dtype=np.int64)])
    return cps, before[offsets - offsets[0]]


def implode(cps: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The texts again."""
    whole = cps.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
