"""Content-defined anchors of a sequence, and the windows around them.

A window of `width` k-grams has its anchor at the least k-gram hash (the first of equals). Whether
a position is the anchor of a window depends on that window alone, so equal windows have their
anchors at equal places, wherever they stand. Every window of `size` >= width + k - 1 elements
holds the anchor of its own first width k-grams, at most width - 1 elements from its start; the
size - width + 1 elements from the anchor on are its core.
"""

from __future__ import annotations

import numpy as np

from fieldloom.llm import _text as t

_PLACE = np.uint64((1 << 26) - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of `width` values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    pad = -len(values) % width
    blocks = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchored(hashed: t.Hasher, at: np.ndarray, size: int, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, and for each the first and last start of the windows of `size` elements (within one text) that have it."""
    none = np.zeros(0, np.int64)
    start = np.flatnonzero(t.inside(at, size))
    if not len(start):
        return none, none, none
    grams = hashed.windows(k)
    place = np.arange(len(grams), dtype=np.uint64)
    low = (sliding_min((grams & ~_PLACE) | (place & _PLACE), width)[start] & _PLACE).astype(np.int64)
    anchor = start + ((low - start) & int(_PLACE))  # the place at or behind the start with these low bits
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return anchor[first], start[first], start[np.append(first[1:], len(start)) - 1]
