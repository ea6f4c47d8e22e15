"""Byte-level BPE encoding and decoding with the vocabulary of a tokenizer file.

A text is cut at special tokens, then into pieces by the pattern of byte-level BPE. A piece of at most SHORT bytes is
encoded over contiguous lists: the boundaries of its parts, their ids, and the rank of each pair of adjacent parts. The least rank
is sought again and again, the boundary inside that pair deleted, and the two neighbouring ranks refreshed. Longer
pieces have the same merges from a heap, as scanning would grow with the square of their length. Each distinct piece of a worker is
encoded once as long as the memo has room (MEMO pieces, then it starts anew), so that a text costs one look-up a piece.

The vocabulary (the merges and tokens of the file, a few MB whatever the input) is read by the driver and broadcast.

Defined results: a null text is empty and has no tokens; a special token's string in a text is that token; decoding null gives
an empty text, an id beyond the vocabulary raises. Texts are encoded whole. Other columns pass through; a new column
replaces an input column of its name.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import _text as t
from fieldloom.llm._tables import table

SHORT = 96
MEMO = 1 << 19
CHUNK = 1 << 16
ROWS = 256
NONE = 1 << 31
SHIFT = 32

# Letters and numbers that Unicode 16 added; older tables of Python lack them
NEW_LETTERS = "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0"
NEW_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNICODE = 16
WIDE = re.compile("[\U00010000-\U0010ffff]")


@cache
def pattern(last: int = 0x10FFFF) -> re.Pattern:
    """The pattern of byte-level BPE for texts of characters up to `last`, with classes in full as Python's own follow other tables.

    Up to U+FFFF a class is one table look-up; beyond, ranges are tried one by one.
    """

    def ranges(kind: str, new: str) -> str:
        spans = [tuple(int(x, 16) for x in r.split("-")) for r in new.split()]
        if float(unicodedata.unidata_version.rsplit(".", 1)[0]) <= UNICODE:  # later letters are none to the vocabulary's library
            of = np.fromiter((unicodedata.category(chr(c))[0] == kind for c in range(0x110000)), bool, 0x110000)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], of, [False]]).astype(np.int8)))
            spans += [(a, b - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
        else:
            raise ValueError("the classes are known up to Unicode 16")
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans if b <= last)

    letters, numbers = ranges("L", NEW_LETTERS), ranges("N", NEW_NUMBERS)
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself where it is one, else from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens and merges of a tokenizer file of byte-level BPE."""

    def __init__(self, path: str):
        """Reads the file; one with parts that are not byte-level BPE alone raises."""
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        model, before = file["model"], file["pre_tokenizer"]
        odd = model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if odd or file["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or file["post_processor"]:
            raise ValueError("not a plain byte-level BPE file")
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in file["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings are not supported")
        byte = byte_of_character()
        raw = lambda token: bytes(byte[c] for c in token)
        self.ids = {raw(token): i for token, i in model["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        pairs = [(raw(a), raw(b)) for a, b in pairs]
        self.ranks = {self.ids[a] << SHIFT | self.ids[b]: rank for rank, (a, b) in enumerate(pairs)}  # a pair of parts as one number
        self.made = [self.ids[a + b] for a, b in pairs]
        self.first = [self.ids[bytes([b])] for b in range(256)]
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        by_id = {i: token for token, i in self.ids.items()} | {i: token.encode() for token, i in self.special.items()}
        self.bytes = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.known = np.array([i in by_id for i in range(len(self.bytes))])

    @cache
    def layout(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length and first byte of each token in all tokens' bytes, and those."""
        size = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        return size, np.cumsum(size) - size, np.frombuffer(b"".join(self.bytes), np.uint8)


def scanned(piece: bytes, v: Vocabulary) -> tuple[list[int], list[int]]:
    """Part boundaries of a short piece and the parts' ids: the least rank of adjacent parts, the first of equals, is merged until none is left."""
    rank, made, first = v.ranks.get, v.made, v.first
    bounds, parts = list(range(len(piece) + 1)), [first[b] for b in piece]
    near = [rank(a << SHIFT | b, NONE) for a, b in zip(parts, parts[1:])]  # near[i]: of the parts that meet at bounds[i + 1]
    while near:
        least = min(near)
        if least == NONE:
            break
        i = near.index(least)
        parts[i] = made[least]
        del bounds[i + 1], near[i], parts[i + 1]
        if i < len(near):
            near[i] = rank(parts[i] << SHIFT | parts[i + 1], NONE)
        if i:
            near[i - 1] = rank(parts[i - 1] << SHIFT | parts[i], NONE)
    return bounds, parts


def heaped(piece: bytes, v: Vocabulary) -> tuple[list[int], list[int]]:
    """The same for a long piece: candidates wait in a heap, and those whose parts have changed are passed over."""
    n, part = len(piece), [v.first[b] for b in piece]  # the part that begins at each boundary that is left
    after, before = list(range(1, n + 2)), list(range(-1, n + 1))
    heap: list[tuple[int, int, int, int]] = []
    gone = bytearray(n + 1)

    def offer(left: int) -> None:
        """The pair of parts that begins at boundary `left`."""
        mid = after[left]
        if mid < n and (r := v.ranks.get(part[left] << SHIFT | part[mid])) is not None:
            heapq.heappush(heap, (r, left, mid, after[mid]))

    for left in range(n - 1):
        offer(left)
    while heap:
        rank, left, mid, right = heapq.heappop(heap)
        if gone[left] or gone[mid] or after[left] != mid or after[mid] != right:
            continue
        gone[mid] = 1
        after[left], before[right], part[left] = right, left, v.made[rank]
        if left:
            offer(before[left])
        if right < n:
            offer(left)
    bounds = [i for i in range(n + 1) if not gone[i]]
    return bounds, [part[i] for i in bounds[:-1]]


class Encoder(dict):
    """Piece to its ids as bytes of 32-bit integers, kept up to MEMO pieces."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        parts = (scanned if len(raw) <= SHORT else heaped)(raw, self.vocabulary)[1]
        out = struct.pack(f"<{len(parts)}i", *parts)
        if len(raw) <= SHORT:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = out
        return out

    def __call__(self, text: str) -> bytes:
        parts, special = (self.cut.split(text) if self.cut else [text]), self.vocabulary.special
        pieces, of = pattern(0x10FFFF if WIDE.search(text) else 0xFFFF).findall, self.__getitem__
        return b"".join(struct.pack("<i", special[x]) if i % 2 else b"".join(map(of, pieces(x))) for i, x in enumerate(parts))


def decoded(ids: np.ndarray, at: np.ndarray, vocabulary: Vocabulary) -> Iterable[str]:
    """The text of each stretch at[i] .. at[i + 1] of ids: the tokens' bytes, joined; bytes that are no UTF-8 become U+FFFD."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(vocabulary.bytes) or not vocabulary.known[ids].all()):
        raise ValueError("an id is not in the vocabulary")
    size, first, flat = vocabulary.layout()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        parts = []
        for low in range(a, b, CHUNK):
            some = ids[low : min(low + CHUNK, b)]
            ends = np.cumsum(size[some])
            parts.append(flat[np.repeat(first[some] - ends + size[some], size[some]) + np.arange(ends[-1])].tobytes())
        yield b"".join(parts).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def with_ids(docs: DataFrame, vocabulary_path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """Adds the token ids of each text."""
    docs = docs.select(*(c for c in docs.columns if c != name))
    names, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        encoder = _encoders.get(id(vocabulary))
        if encoder is None or encoder.vocabulary is not vocabulary:
            _encoders.clear()
            encoder = _encoders[id(vocabulary)] = Encoder(vocabulary)
        for batch in t.slices(batches, text):
            each = [encoder(x or "") for x in t.column(batch, text).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in each])])
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(each), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*names, name])

    return docs.mapInArrow(run, t.arrow_type(docs, f"{name} array<int>"))


def with_text(docs: DataFrame, vocabulary_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the text that each row's ids stand for."""
    docs = docs.select(*(c for c in docs.columns if c != name))
    names, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(low, ROWS) for whole in batches for low in range(0, len(whole), ROWS)):
            lists = t.column(batch, ids)
            at = np.concatenate([[0], np.cumsum(np.nan_to_num(np.array(lists.value_lengths().to_pylist(), float)).astype(np.int64))])
            texts = pa.array(decoded(lists.flatten().to_numpy(zero_copy_only=False), at, shared.value), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*names, name])

    return docs.mapInArrow(run, t.arrow_type(docs, f"{name} string"))


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = with_text(with_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), path)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op12_byte_pairs": op12_byte_pairs}
ORACLE_SQL: dict[str, str] = {}
