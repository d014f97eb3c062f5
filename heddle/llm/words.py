"""The words of many texts as hashes, without a Python object for each word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_TABLE = np.random.default_rng(20240301).integers(0, 2**64, 256, dtype=U)
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes that are hashed together, so that their temporary arrays stay in the processor's cache; a longer word is hashed by itself.
CHUNK = 1 << 15
#: Bytes of text in a part of a batch; a longer text is a part of its own.
PART_BYTES = 1 << 20
_POWERS: list[np.ndarray] = []
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it


def parts(batch: pa.RecordBatch, column: int, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """batch cut into slices of about size bytes of text."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)).astype(np.int64) + 8)
    at = 0
    while at < batch.num_rows:
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, until - at)
        at = until
    trim()


def trim() -> None:
    """Gives memory that this process no longer uses back to the system: Python workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for a chunk are kept."""
    size = max(n, CHUNK)
    if size == CHUNK and _POWERS:
        return _POWERS[0], _POWERS[1]
    made = [np.cumprod(np.append(U(1), np.full(size - 1, b, U)), dtype=U) for b in (_BASE, _INVERSE)]
    if size == CHUNK:
        _POWERS[:] = made
    return made[0], made[1]


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its line's number among all lines, each line's text, its number in that text).

    Words end at ASCII white space, lines at line feeds. A hash depends on the word's bytes alone.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    feeds = np.flatnonzero(data == 10)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    text_of = np.searchsorted(ends, feeds, side="right")
    per_text = np.bincount(text_of, minlength=len(texts))
    number = np.arange(len(feeds)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    space = data == 32
    space |= data - np.uint8(9) < 5  # 9 to 13, as smaller bytes wrap around
    edge = np.flatnonzero(np.append(not space[:1].all(), space[1:] != space[:-1])[: len(data)])  # where words begin and end, by turns
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, U), np.empty(0, np.int64), text_of, number
    h = np.empty(len(start), U)
    cuts = np.flatnonzero(np.append(True, start[1:] // CHUNK != start[:-1] // CHUNK))
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(start)], strict=True):
        j_short = j - (end[j - 1] - start[i] > CHUNK and j - i > 1)  # a last word that leaves the chunk goes by itself
        for a, b in ((i, j_short), (j_short, j)):
            if a < b:
                h[a:b] = _hashed(data[start[a] : end[b - 1]], start[a:b] - start[a], end[a:b] - start[a])
    per_line = np.diff(np.searchsorted(start, feeds), prepend=0)
    return h, np.repeat(np.arange(len(feeds)), per_line), text_of, number


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of data's words, the first of which begins at 0."""
    up, down = _powers(len(data))
    sums = _TABLE.take(data)
    sums *= up[: len(data)]
    np.cumsum(sums, out=sums)
    h = sums[end - 1]
    h[1:] -= sums[start[1:] - 1]
    h *= down[start]
    h += (end - start).astype(U) * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    return h


def sets_of(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, one row after another and sorted by 50 leading bits, and their numbers."""
    order = np.argsort((row.astype(U) << U(50)) | (h >> U(14))) if rows < 1 << 14 else np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
        h, row = h[new], row[new]
    return h, np.bincount(row, minlength=rows)
