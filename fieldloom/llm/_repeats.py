"""Which windows of a fixed size recur in a corpus, exactly and without shuffling all windows.

Windows are gathered in pieces: those with one anchor, `low` to `high` elements in front of it
(see _anchors). A piece has two hashes: its core, which lies in all its windows, and its whole,
which holds them all. A piece whose core is unique has no window that recurs; if its whole recurs,
all its windows do. Only pieces between the two are cut into smaller blocks, aligned to the anchor,
down to single windows; of pieces with equal wholes one stands for all. Cores and wholes are met by
combining aggregations and by joins that Spark can split, so a passage may recur any number
of times, and the rows shuffled follow the number of anchors and of borders of repeats, not of
elements times copies.

Hashes are of 64 bits, cores and wholes are compared together (128 bits).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import _text as t
from fieldloom.llm._anchors import anchored
from fieldloom.llm._automata import earlier_matches
from fieldloom.llm._levels import SuffixLevels
from fieldloom.llm._tables import release, row_key, saved

PIECE = "struct<i:int,low:int,high:int,core:long,whole:long>"
_LIST = pa.list_(pa.struct([("i", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("core", pa.int64()), ("whole", pa.int64())]))


@dataclass(frozen=True)
class Spec:
    """size: elements of a window; width, k: of the anchors; blocks: sizes of the cuts, ending with 1.

    elements: from a batch's bytes and offsets, a hasher of the elements and the texts' offsets in them.
    earlier: a window counts if it stands in a row with a lesser order too, else if it stands anywhere else.
    automata: if over 0, pieces of cores with at most that many are matched by suffix automata, the others by hashes of windows.
    batches: if over 0, the first cores are met by a family of suffix arrays to which that many batches are added.
    """

    size: int
    width: int
    k: int
    blocks: tuple[int, ...]
    elements: Callable[[np.ndarray, np.ndarray], tuple[t.Hasher, np.ndarray]]
    earlier: bool
    automata: int = 0
    batches: int = 0


def pieces_of(hashed: t.Hasher, at: np.ndarray, of: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, size: int, core: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """A list for each text of its pieces, given in the order of texts."""
    begin = anchor - high
    salt = (low.astype(np.uint64) << np.uint64(32)) | high.astype(np.uint64)
    whole = t.mix(hashed(begin, anchor - low + size) ^ t.mix(salt))
    fields = [(anchor - at[of]).astype(np.int32), low.astype(np.int32), high.astype(np.int32), hashed(*core).view(np.int64), whole.view(np.int64)]
    structs = pa.StructArray.from_arrays([pa.array(x) for x in fields], fields=list(_LIST.value_type))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(at))).astype(np.int32)), structs)


def first_pieces(hashed: t.Hasher, at: np.ndarray, spec: Spec) -> pa.Array:
    anchor, first, last = anchored(hashed, at, spec.size, spec.width, spec.k)
    core = (anchor, anchor + spec.size - spec.width + 1)
    return pieces_of(hashed, at, t.owner(at, anchor), anchor, anchor - last, anchor - first, spec.size, core)


def smaller_pieces(hashed: t.Hasher, at: np.ndarray, found: pa.Array, spec: Spec, block: int) -> pa.Array:
    """The blocks of `block` windows, aligned to the anchor and cut at the text's ends, that given pieces reach."""
    of = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
    flat = found.flatten()
    anchor, low, high = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "low", "high"))
    anchor = anchor + at[of]
    count = high // block - low // block + 1
    many = np.repeat(np.arange(len(anchor)), count)
    floor = (np.arange(len(many)) - np.repeat(np.cumsum(count) - count, count) + low[many] // block) * block
    of, anchor = of[many], anchor[many]
    core = (anchor - floor, anchor - (floor + block - 1) + spec.size)
    low = np.maximum(floor, anchor + spec.size - at[of + 1])
    high = np.minimum(floor + block - 1, anchor - at[of])
    return pieces_of(hashed, at, of, anchor, low, high, spec.size, core)


def _exploded(table: DataFrame) -> DataFrame:
    return table.select("uid", "ord", F.explode("pieces").alias("p")).select("uid", "ord", "p.*")


def _settled(pieces: DataFrame, spec: Spec, last: bool, cores: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Pieces all of whose windows count, and those to be cut further (with one for each whole that they may meet).

    cores: those that stand in two places, if they are known.
    """
    if spec.earlier:
        twice, extent = F.expr("min(ord) < max(ord)"), [F.min("ord").alias("least")]
        counts, more = F.expr("least < ord"), F.expr("ord = least")
        opened = F.expr("min(least) < max(least)")
    else:
        place = F.struct("uid", "i")
        twice, extent = F.expr("count(*) > 1"), [F.min(place).alias("least"), F.max(place).alias("most")]
        counts, more = F.expr("least != most"), F.expr("least = struct(uid, i)")
        opened = F.expr("count(*) > 1 and bool_or(least = most)")
    if cores is None:
        cores = saved(pieces.groupBy("core").agg(twice.alias("twice")).filter("twice").select("core"))
    # what an aggregation has made is written before it is joined: Spark splits only joins that read plain shuffles
    met = saved(pieces.join(cores, "core"))
    wholes = saved(met.groupBy("core", "whole").agg(*extent))
    both = met.join(wholes, ["core", "whole"])
    done = both.filter(counts).select("uid", "i", "low", "high")
    if last:
        return done, None
    open_cores = saved(wholes.groupBy("core").agg(opened.alias("opened")).filter("opened").select("core"))
    return done, both.filter(more).join(open_cores, "core").select("uid", "i", "low", "high", "core")


def _packed(codes: np.ndarray) -> np.ndarray:
    """Five bytes of each code; within a core, which is compared by 64 bits, that tells words apart."""
    return codes.view(np.uint8).reshape(-1, 8)[:, :5]


def _segments(spec: Spec, text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each listed piece, with the codes of the elements of its whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in t.slices(batches, text):
            hashed, at = spec.elements(*t.utf8(t.column(batch, text)))
            places = np.arange(int(at[-1]))
            codes = _packed(hashed(places, places + 1)).tobytes()
            found = t.column(batch, "found")
            of = np.repeat(np.arange(len(batch)), np.diff(found.offsets.to_numpy()))
            i, low, high = (found.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "low", "high"))
            begin, end = (i - high + at[of]).tolist(), (i - low + spec.size + at[of]).tolist()
            take = lambda c: t.column(batch, c).take(pa.array(of))
            arrays = [found.flatten().field("core"), take("ord"), take("uid"), pa.array((i - high).astype(np.int32)), pa.array([codes[5 * a : 5 * b] for a, b in zip(begin, end)], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["core", "ord", "uid", "start", "codes"])

    return run


def _by_automata(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams the pieces of one core after the other, sorted by (core, ord): an automaton of those that came before, then the next."""

    def solved(group: list[tuple]) -> tuple[list[int], list[int]]:
        segments = [(order, [codes[k : k + 5] for k in range(0, len(codes), 5)]) for order, _, _, codes in group]
        uids, starts = [], []
        for (_, uid, start, _), found in zip(group, earlier_matches(segments, size)):
            uids += [uid] * len(found)
            starts += [start + k for k in found]
        return uids, starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, group = None, []
        for batch in batches:
            uids, starts = [], []
            for c, *row in zip(*(t.column(batch, n).to_pylist() for n in ("core", "ord", "uid", "start", "codes"))):
                if c != core:
                    if len(group) > 1:
                        u, s = solved(group)
                        uids += u
                        starts += s
                    core, group = c, []
                group.append(tuple(row))
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(starts, pa.int32())], names=["uid", "i"])
        if len(group) > 1:
            u, s = solved(group)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(s, pa.int32())], names=["uid", "i"])

    return run


def recurring(docs: DataFrame, spec: Spec, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(row_a, row_b, starts): for rows (by row_key of id and text), element positions of windows that count.

    Not every window that counts is listed, but the listed ones cover every element that those do.
    """
    keyed = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63))).alias("ord"), *row_key(id, text), F.col(text).alias(text))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in t.slices(batches, text):
            uid = pa.array(np.arange(number, number + len(batch)))
            number += len(batch)
            rest = [t.column(batch, c) for c in ("ord", "row_a", "row_b")]
            yield pa.RecordBatch.from_arrays([uid, *rest, first_pieces(*spec.elements(*t.utf8(t.column(batch, text))), spec)], names=["uid", "ord", "row_a", "row_b", "pieces"])

    def cut(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in t.slices(batches, text):
                found = smaller_pieces(*spec.elements(*t.utf8(t.column(batch, text))), t.column(batch, "found"), spec, block)
                yield pa.RecordBatch.from_arrays([t.column(batch, "uid"), t.column(batch, "ord"), found], names=["uid", "ord", "pieces"])

        return run

    def with_texts(left: DataFrame) -> DataFrame:
        """Rows that hold listed pieces: uid, ord, text and found, the list. Of rows with equal keys one stands for all."""
        lists = saved(left.groupBy("uid").agg(F.collect_set(F.struct("i", "low", "high", "core")).alias("found")))
        release(docs)
        return keyed.join(chosen.join(lists, "uid"), ["row_a", "row_b"]).select("uid", "ord", F.sort_array("found").alias("found"), text)

    base = f"uid long, ord long, row_a long, row_b long, pieces array<{PIECE}>"
    first = saved(keyed.mapInArrow(start, base))
    rows = first.select("uid", "row_a", "row_b")
    chosen = saved(rows.groupBy("row_a", "row_b").agg(F.min("uid").alias("uid")))
    pieces, done, cores = _exploded(first), [], None
    if spec.batches:
        family = SuffixLevels()
        shared = [family.add(pieces.filter(F.pmod(F.xxhash64("uid"), F.lit(spec.batches)) == b).select("core")) for b in range(spec.batches)]
        cores = saved(reduce(DataFrame.union, shared).distinct())
    for block in spec.blocks:
        settled, left = _settled(pieces, spec, False, cores)
        cores = None
        done.append(settled)
        if spec.automata:
            left = saved(left)
            sizes = left.groupBy("core").agg(F.count("*").alias("n"))
            hot = saved(sizes.filter(F.col("n") > spec.automata).select("core"))
            few = with_texts(left.join(hot, "core", "left_anti"))
            segments = few.mapInArrow(_segments(spec, text), "core long, ord long, uid long, start int, codes binary")
            solved = segments.repartition("core").sortWithinPartitions("core", "ord").mapInArrow(_by_automata(spec.size), "uid long, i int")
            done.append(saved(solved.select("uid", "i", F.lit(0).alias("low"), F.lit(0).alias("high"))))
            release(docs)
            left = left.join(hot, "core", "left_semi")
        texts = with_texts(left)
        pieces = _exploded(saved(texts.mapInArrow(cut(block), f"uid long, ord long, pieces array<{PIECE}>")))
        release(docs)
    done.append(_settled(pieces, spec, True)[0])
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    starts = every.select("uid", F.explode(F.array_distinct(F.array(F.expr("i - low"), F.expr("i - high")))).alias("p"))
    starts = saved(starts.groupBy("uid").agg(F.collect_list("p").alias("starts")))
    release(docs)
    placed = starts.join(rows, "uid").select("row_a", "row_b", F.explode("starts").alias("p"))
    return placed.groupBy("row_a", "row_b").agg(F.collect_set("p").alias("starts"))
