"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of bounded size. Its words become symbols, each document
ends with a separator of its own, and the suffix array gives the Burrows-Wheeler transform,
kept as a wavelet matrix whose prefix counts answer rank queries. All windows of the test
items are searched backwards at once; the rows of their intervals are located by walking to
sampled suffix positions. Hit words of a document merge into spans to remove.

No shuffle: each task indexes its own documents, one shard at a time. The test items are the
broadcast side; the size of their windows is measured first, and beyond `block_bytes` they are handled in
blocks, one pass over the documents for each, so nothing larger is ever broadcast.

Defined results: a null text has no words and no hits; an item without words has no window;
an item of fewer words than a window is one window; repeated items and windows count once per
item id; a null item id reads "null"; an empty table of items marks nothing. Other columns
pass through; new columns (NEW) replace input columns so named. A document longer than a
shard is a shard of its own. Windows are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import _text as t
from fieldloom.llm._tables import packed, table

NEW = "n_words long, n_hit long, items array<string>, spans array<struct<first:long,last:long>>"
WINDOW = 10


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix tripling; after the first round only suffixes that are still tied are sorted.

    The rank of a suffix is the place of its group's first member, so groups refine on their own.
    """
    n = len(symbols)
    arity = 3 if n + 1 < 1 << 21 else 2
    bits = np.uint64(21 if arity == 3 else 32)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    order, h = np.arange(n), 1
    slot = np.zeros(0, np.int64)  # places of the suffix array that `part` may fill
    part, first = order, True
    array = np.empty(n, np.int64)
    padded = np.zeros(n + 1, np.int64)
    while True:
        padded[:n] = rank + 1
        key = padded[part].astype(np.uint64)
        for k in range(1, arity):
            key = (key << bits) | padded[np.minimum(part + k * h, n)].astype(np.uint64)
        turn = np.argsort(key)
        part, key = part[turn], key[turn]
        new = np.ones(len(part), bool)
        new[1:] = key[1:] != key[:-1]
        if first:
            slot, first = np.arange(n), False
        array[slot] = part
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(part)))
        rank[part] = np.repeat(slot[begin], size)
        tied = np.repeat(size > 1, size)
        if not tied.any():
            return array
        part, slot = part[tied], slot[tied]
        h *= arity


class FMIndex:
    """Search and locate in documents given as a sequence of word codes and its offsets."""

    def __init__(self, codes: np.ndarray, at: np.ndarray, rate: int = 16):
        texts = len(at) - 1
        self.vocabulary, ids = np.unique(codes, return_inverse=True)
        n = len(codes) + texts
        # documents' words stand at their own index plus the number of documents before them
        symbols = np.empty(n, np.int64)
        ends = at[1:] + np.arange(texts)
        of_word = np.ones(n, bool)
        of_word[ends] = False
        symbols[of_word] = ids + texts
        symbols[ends] = np.arange(texts)
        array = suffix_array(symbols)
        symbols = np.where(of_word, symbols - texts + 1, 0)
        self.n, self.begins = n, np.concatenate([[0], ends[:-1] + 1]) if texts else np.zeros(0, np.int64)
        sigma = len(self.vocabulary) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))]).astype(np.int64)
        sampled = array % rate == 0
        starts = np.zeros(n, bool)
        starts[self.begins] = True
        sampled |= starts[array]
        self.sampled, self.sample_rank, self.samples = sampled, np.cumsum(sampled) - 1, array[sampled]
        level = symbols[array - 1]  # the transform
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros, self.base = [], [], np.zeros(sigma, np.int64)
        every = np.arange(sigma)
        for b in reversed(range(self.bits)):
            bit = (level >> b) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = n - int(ones[-1])
            self.ones.append(ones)
            self.zeros.append(zeros)
            level = np.concatenate([level[bit == 0], level[bit == 1]])
            self.base = np.where((every >> b) & 1, zeros + ones[self.base], self.base - ones[self.base])

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows before the first that is preceded by `symbol` at or after `row`: one step of backward search."""
        at = row
        for b, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros):
            before = ones[at]
            at = np.where((symbol >> b) & 1, zeros + before, at - before)
        return self.first[symbol] + at - self.base[symbol]

    def preceding(self, row: np.ndarray) -> np.ndarray:
        """The symbol in front of each row's suffix."""
        at, symbol = row, np.zeros(len(row), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            before = ones[at]
            bit = ones[at + 1] - before
            symbol = symbol * 2 + bit
            at = np.where(bit, zeros + before, at - before)
        return symbol

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of rows for each pattern (a row of word codes, all of one length)."""
        count, size = patterns.shape
        lo, hi = np.zeros(count, np.int64), np.zeros(count, np.int64)
        if not len(self.vocabulary):
            return lo, hi
        place = np.minimum(np.searchsorted(self.vocabulary, patterns), len(self.vocabulary) - 1)
        live = np.flatnonzero((self.vocabulary[place] == patterns).all(axis=1))
        a, b = np.zeros(len(live), np.int64), np.full(len(live), self.n)
        for k in reversed(range(size)):
            symbol = place[live, k] + 1
            a, b = self.step(symbol, a), self.step(symbol, b)
            some = a < b
            live, a, b = live[some], a[some], b[some]
        lo[live], hi[live] = a, b
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Position of each row's suffix, in words."""
        out, at, steps = np.empty(len(row), np.int64), row.copy(), 0
        todo = np.arange(len(row))
        while len(todo):
            done = self.sampled[at]
            out[todo[done]] = self.samples[self.sample_rank[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            if len(todo):
                at = self.step(self.preceding(at), at)
            steps += 1
        return out - (np.searchsorted(self.begins, out, "right") - 1)


class Phrases:
    """The distinct windows of test items, by length, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for i, text in items:
            raw = t.LOWER[np.frombuffer(text.encode(), np.uint8)]
            start, end, _ = t.words(raw, np.array([0, len(raw)]), t.ALNUM)
            if len(start):
                codes = t.byte_hasher(raw)(start, end)
                rows = np.lib.stride_tricks.sliding_window_view(codes, min(window, len(codes)))
                found.setdefault(rows.shape[1], []).append((rows, np.full(len(rows), number[i])))
        self.groups = []
        for _, parts in sorted(found.items()):
            rows, of = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            patterns, which = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), of], axis=1), axis=0)
            self.groups.append((patterns, np.searchsorted(pairs[:, 0], np.arange(len(patterns) + 1)), pairs[:, 1]))


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the intervals, and the interval of each."""
    size = hi - lo
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + lo[of], of


def hits(buf: np.ndarray, at: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and offsets of a shard, which words are hit, and distinct (document, item) pairs."""
    raw = t.LOWER[buf]
    start, end, word_at = t.words(raw, at, t.ALNUM)
    hit, pairs = np.zeros(len(start), bool), []
    if len(start):
        index = FMIndex(t.byte_hasher(raw)(start, end), word_at)
        for patterns, item_at, items in phrases.groups:
            lo, hi = index.search(patterns)
            rows, of = _spread(lo, hi)
            if len(rows):
                place = index.locate(rows)
                hit |= t.covered(place, patterns.shape[1], len(start))
                member, occurrence = _spread(item_at[of], item_at[of + 1])
                pairs.append(np.unique(np.stack([t.owner(word_at, place)[occurrence], items[member]], axis=1), axis=0))
    return start, end, word_at, hit, np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)


def _pass(docs: DataFrame, text: str, items: list[tuple[str, str]], window: int, prior: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Phrases(items, window))
    new = [x.split()[0] for x in NEW.split(", ")]
    names = [c for c in docs.columns if c not in new]
    span = pa.struct([("first", pa.int64()), ("last", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch in t.slices(batches, text):
            buf, at = t.utf8(t.column(batch, text))
            start, end, word_at, hit, pairs = hits(buf, at, phrases)
            known: list[list[str]] = [[] for _ in range(len(batch))]
            for d, i in pairs.tolist():
                known[d].append(phrases.items[i])
            if prior:
                for d, (more, cut) in enumerate(zip(t.column(batch, "items").to_pylist(), t.column(batch, "spans").to_pylist())):
                    known[d] = sorted({*known[d], *more})
                    for s in cut:
                        hit[np.searchsorted(start, at[d] + s["first"]) : np.searchsorted(start, at[d] + s["last"])] = True
            first, last = t.runs(hit, word_at)
            of = t.owner(word_at, first)
            spans: list[list[dict]] = [[] for _ in range(len(batch))]
            for d, a, b in zip(of.tolist(), (start[first] - at[of]).tolist(), (end[last - 1] - at[of]).tolist()):
                spans[d].append({"first": a, "last": b})
            arrays = [pa.array(np.diff(word_at)), pa.array(t.per_text(hit, word_at)), pa.array(known, pa.list_(pa.string())), pa.array(spans, pa.list_(span))]
            yield pa.RecordBatch.from_arrays([*(t.column(batch, c) for c in names), *arrays], names=[*names, *new])

    return docs.mapInArrow(run, t.arrow_type(docs.select(*names), NEW))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = 16 << 20) -> DataFrame:
    """Every row with n_words, n_hit, items (ids, sorted) and spans (byte ranges of hit words).

    block_bytes: the most that a pass broadcasts, by the windows' codes and not by the items' text, of which they are about 16 times.
    """
    new = [x.split()[0] for x in NEW.split(", ")]
    docs = docs.drop(*new)
    asked = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.col(item_text).alias("x")).filter("x is not null")
    # what is broadcast: the codes of each window (8 bytes a word of it), its place, and the items' names
    words = F.regexp_count("x", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    total = asked.agg(F.sum(words * (8 * (window + 2)) + F.octet_length("i"))).first()[0] or 0
    blocks = total // block_bytes + 1
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("i", "x"), F.lit(blocks)) == b)
        docs = _pass(docs, text, [(r["i"], r["x"]) for r in part.collect()], window, prior=b > 0)
    return docs


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", n_chars: str | None = "n_chars", **options) -> DataFrame:
    """The rows in their own columns with every span taken out of the text; rows of which nothing but white space is left go.

    Rows without hits are left as they are.
    """
    inner, own = packed(docs, text)
    inner = inner.withColumnRenamed(text, "_text")
    names = inner.columns
    marked = contaminated(inner, benchmark, "_text", **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = t.column(batch, "_text").to_pylist(), []
            for d, cut in enumerate(t.column(batch, "spans").to_pylist()):
                if cut:
                    raw, parts, at = texts[d].encode(), [], 0
                    for s in cut:
                        parts.append(raw[at : s["first"]])
                        at = s["last"]
                    texts[d] = b"".join([*parts, raw[at:]]).decode()
                keep.append(not cut or bool(texts[d].strip()))
            put = {"_text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([put.get(c, t.column(batch, c)) for c in names], names=names).filter(pa.array(keep))

    found = marked.mapInArrow(run, inner.schema)
    out = found.select(*(F.col("_text").alias(text) if c == text else x for c, x in zip(docs.columns, own)))
    return out.withColumn(n_chars, F.char_length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else out


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op2_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op2_fm_index": op2_fm_index}
ORACLE_SQL = {
    "op2_fm_index": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
parts AS (SELECT DISTINCT item_id, w[i:i + least(len(w), 10) - 1] AS part FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(part) AS size FROM parts),
windows AS (SELECT doc_id, i, w[i:i + size - 1] AS part FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes)),
met AS (SELECT doc_id, i, len(part) AS size, item_id FROM windows JOIN parts USING (part)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM met)) GROUP BY doc_id),
seen AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN seen USING (doc_id)
"""
}
