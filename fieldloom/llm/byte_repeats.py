"""Suffix-array dedup: bytes in strings of `size` bytes that stand anywhere else go.

Documents come in batches. Each batch's suffixes, sampled at content-defined anchors so that every string
of `size` bytes holds one, form a sparse suffix array; it is merge-scanned against the levels of a
logarithmic family of such arrays (see _levels), and equal-sized levels merge. Suffixes that agree on
their first bytes are then compared in full, in blocks down to single strings (see _repeats), which
gives the exact extent of every long match, backward from the anchor as well as forward.

Strings are judged on the input: all occurrences go, in the same row too.

Defined results: a null text has no bytes; texts shorter than `size` lose nothing; rows equal in id and
text each count as a place, so both lose what they share; what is left is binary, as a cut may split a
character; ids may be null or repeated; other columns pass through and new ones (kept, n_bytes,
n_removed, n_spans) replace columns so named; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import _text as t
from fieldloom.llm._repeats import Spec, recurring
from fieldloom.llm._tables import table, with_found

SIZE = 400
BATCHES = 4


def _bytes(buf: np.ndarray, at: np.ndarray) -> tuple[t.Hasher, np.ndarray]:
    return t.byte_hasher(buf), at


def spec(size: int = SIZE, batches: int = BATCHES) -> Spec:
    k = max(1, min(16, size // 8))
    return Spec(size, max(1, min(250, size * 5 // 8, size - k + 1)), k, (16, 1), _bytes, earlier=False, batches=batches)


def deduplicated(docs: DataFrame, text: str = "text", id: str = "doc_id", size: int = SIZE, batches: int = BATCHES) -> DataFrame:
    """Every row with kept (the bytes left), n_bytes, n_removed and n_spans."""
    new = "kept binary, n_bytes long, n_removed long, n_spans long"
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    names = docs.columns
    starts = recurring(docs, spec(size, batches), text, id)
    met, at_starts = with_found(docs, starts, text, id, "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in t.slices(batches, text):
            buf, at = t.utf8(t.column(batch, text))
            found = t.column(batch, at_starts)
            of = np.repeat(np.arange(len(batch)), [0 if x is None else x for x in pa.compute.list_value_length(found).to_pylist()])
            gone = t.covered(found.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + at[of], size, len(buf))
            begin, _ = t.runs(gone, at)
            removed = t.per_text(gone, at)
            kept_at = np.concatenate([[0], np.cumsum(np.diff(at) - removed)])
            left = buf[~gone].tobytes()
            kept = pa.array([left[a:b] for a, b in zip(kept_at[:-1].tolist(), kept_at[1:].tolist())], pa.binary())
            arrays = [kept, pa.array(np.diff(at)), pa.array(removed), pa.array(np.bincount(t.owner(at, begin), minlength=len(batch)))]
            yield pa.RecordBatch.from_arrays([*(t.column(batch, c) for c in names), *arrays], names=[*names, "kept", "n_bytes", "n_removed", "n_spans"])

    return met.mapInArrow(run, t.arrow_type(docs, new))


def op3_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op3_byte_repeats": op3_byte_repeats}
ORACLE_SQL: dict[str, str] = {}
