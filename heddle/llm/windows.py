"""Hashes of all windows of a byte string, and content-defined anchors that cover every window, in numpy.

An anchor is the position of the smallest k-byte hash inside a window. It depends on the window's bytes alone, so equal
windows have equal anchors at equal offsets: the anchors cover all differences of positions, as a difference cover
modulo v does, but with about 2 / (window - k + 2) of all positions instead of about 1.2 / sqrt(v).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_MUL = U(0x9E3779B97F4A7C15)
_MIX = U(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=1)
def _bytes_table() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=U)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a string from those of its first and second part."""
    x = a * _MUL
    x ^= x >> U(29)
    x += b
    x *= _MIX
    x ^= x >> U(32)
    return x


def window_hashes(data: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size the hashes of all windows of so many bytes, by doubling."""
    most, power, k = max(sizes), {1: _bytes_table()[data]}, 1
    while 2 * k <= most:
        h = power[k]
        n = max(0, len(h) - k)
        power[2 * k] = _join(h[:n], h[k : k + n])
        k *= 2
    out = []
    for size in sizes:
        bits = [1 << i for i in range(size.bit_length() - 1, -1, -1) if size >> i & 1]
        h, done = power[bits[0]], bits[0]
        for b in bits[1:]:
            n = max(0, len(data) - done - b + 1)
            h, done = _join(h[:n], power[b][done : done + n]), done + b
        out.append(h[: max(0, len(data) - size + 1)])
    return out


#: Bytes of a piece that is hashed at once: its arrays stay in the processor's cache.
PIECE = 1 << 16
_POSITION = U(18)  # bits that hold a position inside a piece


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of width values the position of the smallest by their leading 46 bits, the first one of equals."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    assert len(h) <= 1 << int(_POSITION)
    blocks = -(-len(h) // width)
    grid = np.full(blocks * width, np.iinfo(U).max, U)
    grid[: len(h)] = (h >> _POSITION << _POSITION) | np.arange(len(h), dtype=U)
    grid = grid.reshape(blocks, width)
    prefix = np.ascontiguousarray(grid.T)  # accumulated along the long axis, row by row
    suffix = prefix.copy()
    for i in range(1, width):
        np.minimum(prefix[i], prefix[i - 1], out=prefix[i])
        np.minimum(suffix[width - 1 - i], suffix[width - i], out=suffix[width - 1 - i])
    prefix, suffix = prefix.T.ravel(), suffix.T.ravel()
    least = np.minimum(suffix[:n], prefix[width - 1 : width - 1 + n])
    return (least & U((1 << int(_POSITION)) - 1)).astype(np.int64)


def anchors(data: np.ndarray, valid: np.ndarray | None, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows that share their anchor: (first window, number of windows, anchor position, anchor hash).

    valid: which window starts count; a run never spans a window that doesn't.
    """
    (h,) = window_hashes(data, k)
    pos = sliding_argmin(h, window - k + 1)
    if not len(pos):
        e = np.empty(0, np.int64)
        return e, e, e, np.empty(0, U)
    cut = np.empty(len(pos), bool)
    cut[0] = True
    np.not_equal(pos[1:], pos[:-1], out=cut[1:])
    if valid is not None:
        cut[1:] |= valid[1:] != valid[:-1]
    first = np.flatnonzero(cut)
    count = np.diff(np.append(first, len(pos)))
    if valid is not None:
        keep = valid[first]
        first, count = first[keep], count[keep]
    at = pos[first]
    return first, count, at, h[at]
