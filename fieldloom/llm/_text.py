"""Vectorised text primitives shared by the corpus operators.

Everything works on the UTF-8 buffer of an Arrow column, so a batch of texts is
tokenised and hashed by a handful of numpy passes instead of a Python loop per word.
Substring hashes are polynomial, modulo 2**64 over random byte codes, taken from
prefix sums and finished by a mixer: equal byte strings have equal hashes wherever
they stand, and different ones collide with a probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.RandomState(20240613).randint(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
NOT_SPACE = ~SPACES
#: The bytes of words that hold ASCII letters, digits and every character from U+0080 on.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    got = _powers[base]
    while len(got) < n:
        got = np.concatenate([got, got * np.uint64(pow(base, len(got), 1 << 64))])
    _powers[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Hashes of any subsequences of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray):
        self.prefix = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * powers(_BASE, len(codes)), out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * powers(_INVERSE, len(self.prefix))[start])

    def windows(self, size: int) -> np.ndarray:
        """The hash of each window of `size`; windows may cross texts, which the caller rules out."""
        n = max(0, len(self.prefix) - size)
        return mix((self.prefix[size:] - self.prefix[:n]) * powers(_INVERSE, len(self.prefix))[:n]) if n else np.zeros(0, np.uint64)


def byte_hasher(buf: np.ndarray) -> Hasher:
    return Hasher(_CODES[buf])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each (one more than texts); null is empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return buf, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each has at most `limit` bytes of text, or a single row."""
    for batch in batches:
        if not len(batch):
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < len(batch):
            end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def runs(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values; no run crosses a text's border."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    begins = mask.copy()
    begins[1:] &= ~mask[:-1] | cut[1:n]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:] | cut[1:n]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def owner(at: np.ndarray, position: np.ndarray) -> np.ndarray:
    """The text that each position lies in."""
    return np.searchsorted(at, position, "right") - 1


def words(buf: np.ndarray, at: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the offset of each text in the sequence of words."""
    start, end = runs(table[buf], at)
    return start, end, np.searchsorted(start, at, "left")


def inside(at: np.ndarray, size: int) -> np.ndarray:
    """Which window starts (0 .. last offset - size) lie within one text."""
    n = int(at[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    delta = np.zeros(int(at[-1]) + 2, np.int32)
    begin, end = at[:-1], np.maximum(at[:-1], at[1:] - size + 1)
    np.add.at(delta, begin, 1)
    np.add.at(delta, end, -1)
    return np.cumsum(delta)[:n] > 0


def covered(start: np.ndarray, size, n: int) -> np.ndarray:
    """Which of n positions some span [start, start + size) covers."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, start + size, -1)
    return np.cumsum(delta)[:n] > 0


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values (one per position) over each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def repeated(key: np.ndarray) -> np.ndarray:
    """Which elements have an equal one elsewhere."""
    out = np.zeros(len(key), bool)
    if len(key) > 1:
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        out[order[1:]] = same
        out[order[:-1]] |= same
    return out


def arrow_type(df, extra: str = ""):
    """DDL-free schema for mapInArrow: the frame's own fields, then those of a DDL string."""
    from pyspark.sql import types as T

    more = T._parse_datatype_string(extra).fields if extra else []
    return T.StructType([*df.schema.fields, *more])
