"""Substring dedup by suffix automata: words in windows of `size` words that also stand in a row with a lesser id go.

The reference is every document with a lesser id. One automaton of it, or a broadcast one of each of its
shards, would have to see every document, so work would grow with the square of the corpus. The shards here
are cut by content instead: passages around a content-defined anchor (see _anchors) go to the shard of
their core, which every equal window shares. A shard's passages are streamed in order of id: matching
statistics against the automaton of those before give the windows that stand earlier, then the passage
joins the automaton. Passages equal as a whole are settled before, by one aggregation, so a
shard holds different ones only. Shards of more than AUTOMATA passages are split by comparing hashes of
single windows in combining aggregations, which gives the same result without bound on a shard's size.

Defined results: windows are judged on the input; a null text has no words; texts shorter than a window lose
nothing; null ids come first, and rows with equal ids do not count as earlier than each other; other
columns pass through and new ones (kept, n_words, n_removed) replace columns so named; an empty table gives
an empty result. Ids are whole numbers.
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

SIZE = 50
AUTOMATA = 256


def _words(buf: np.ndarray, at: np.ndarray) -> tuple[t.Hasher, np.ndarray]:
    start, end, word_at = t.words(buf, at)
    return t.Hasher(t.byte_hasher(buf)(start, end)), word_at


def spec(size: int = SIZE, automata: int = AUTOMATA) -> Spec:
    k = max(1, min(4, size // 8))
    return Spec(size, max(1, min(26, size * 5 // 8, size - k + 1)), k, (1,), _words, earlier=True, automata=automata)


def deduplicated(docs: DataFrame, text: str = "text", id: str = "doc_id", size: int = SIZE, automata: int = AUTOMATA) -> DataFrame:
    """Every row with kept (the words left, joined by spaces), n_words and n_removed."""
    new = "kept string, n_words long, n_removed long"
    docs = docs.drop("kept", "n_words", "n_removed")
    names = docs.columns
    starts = recurring(docs, spec(size, automata), text, id)
    met, at_starts = with_found(docs, starts, text, id, "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in t.slices(batches, text):
            buf, at = t.utf8(t.column(batch, text))
            start, end, word_at = t.words(buf, at)
            found = t.column(batch, at_starts)
            of = np.repeat(np.arange(len(batch)), [0 if x is None else x for x in pa.compute.list_value_length(found).to_pylist()])
            gone = t.covered(found.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + word_at[of], size, len(start))
            # kept bytes: those of kept words, each with a space in front unless it is the first
            raw, kept = buf.tobytes(), []
            cut = np.flatnonzero(~gone)
            left_at = np.searchsorted(cut, word_at)
            s, e = start[cut].tolist(), end[cut].tolist()
            for a, b in zip(left_at[:-1].tolist(), left_at[1:].tolist()):
                kept.append(b" ".join([raw[x:y] for x, y in zip(s[a:b], e[a:b])]).decode())
            arrays = [pa.array(kept, pa.string()), pa.array(np.diff(word_at)), pa.array(t.per_text(gone, word_at))]
            yield pa.RecordBatch.from_arrays([*(t.column(batch, c) for c in names), *arrays], names=[*names, "kept", "n_words", "n_removed"])

    return met.mapInArrow(run, t.arrow_type(docs, new))


def op10_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


QUERIES = {"op10_word_repeats": op10_word_repeats}
ORACLE_SQL = {
    "op10_word_repeats": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM starts),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM windows) WHERE doc_id > least),
gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM later) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[k] FOR k IN range(1, len(w) + 1) IF NOT list_contains(gone, k)] END, ' ')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
"""
}
