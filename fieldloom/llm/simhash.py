"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most `radius` bits apart have a fingerprint between them that is at
most half the radius from either. So each distinct fingerprint emits every variant within
half the radius; after a shuffle on the variant, fingerprints that meet are candidates. A
variant meets at most as many fingerprints as its own ball holds (65 for radius 2), so no
group is large, whatever the number of copies: equal fingerprints are merged before.
Members of a group are linked to its least and to the one before, not pair by pair; with
half the radius on either side all members of a ball are within the radius of each other,
so the components are those of all pairs.

Components of the links between distinct fingerprints are found by large and small stars
(operators.graphs.components).

Defined results: null and empty texts have fingerprint 0 and link like any other; equal
fingerprints are one class; rows without doc_id form classes like others but never give
a component its id. clusters() gives a row for each input row with its id, fingerprint and component and no
other column; deduplicated() gives whole rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm import _text as t
from fieldloom.llm._tables import Scratch, release, row_key, saved, table
from fieldloom.operators.graphs import components

BITS = 64
#: Least and most bits of a sketch, and members of a block of them.
SKETCH_BITS = (1 << 10, 1 << 14)
COMPARED = 256


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` words joined by a space; of all words if fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words])
    start = np.concatenate([[0], end[:-1]]).tolist()
    end = (end - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hashed(joined, 42)], np.uint64)
    return np.array([hashed(joined[s:e], 42) for s, e in zip(start, end[size - 1 :])], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "simhash") -> DataFrame:
    """Adds the fingerprint as a signed 64-bit integer."""
    docs = docs.drop(name)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in t.slices(batches, text):
            buf, at = t.utf8(t.column(batch, text))
            low = t.LOWER[buf].tobytes()
            prints = [fingerprint(shingle_hashes(low[a:b].split(), shingle)) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(prints, np.uint64).view(np.int64))], names=[*names, name])

    return docs.mapInArrow(run, t.arrow_type(docs, f"{name} long"))


def masks(distance: int) -> list[int]:
    """All signed 64-bit masks of at most `distance` bits."""
    out = []
    for n in range(distance + 1):
        for bits in combinations(range(BITS), n):
            value = sum(1 << b for b in bits)
            out.append(value - (1 << 64) if value >> 63 else value)
    return out


def links(prints: DataFrame, radius: int = 2, name: str = "simhash") -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints; their components are those of all pairs within the radius.

    The radius is even, as variants split it in halves.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    emitted = prints.select(F.col(name).alias("b")).distinct().select("b", F.explode(F.lit(np.array(masks(radius // 2), np.int64))).alias("mask"))
    ball = Window.partitionBy("variant")
    met = emitted.select("b", F.col("b").bitwiseXOR(F.col("mask")).alias("variant")).withColumn("least", F.min("b").over(ball))
    met = met.withColumn("before", F.lag("b").over(ball.orderBy("b"))).filter("b > least")
    ends = met.select("b", F.explode(F.array_distinct(F.array("least", "before"))).alias("a"))
    return ends.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b").distinct()


def clusters(docs: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, simhash, component_id) of every row: component_id is the least id within reach."""
    prints = saved(with_fingerprint(docs.select(id, text), text, shingle).drop(text))
    classes = saved(prints.groupBy("simhash").agg(F.min(id).alias("least")))
    roots = components(links(classes.select("simhash"), radius))
    joined = classes.join(roots, classes.simhash == roots.node, "left").select("simhash", "least", F.coalesce("root", "simhash").alias("root"))
    of_root = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = joined.join(of_root, "root").select("simhash", "component_id")
    return prints.join(by_print, "simhash")


def word_fingerprints(buf: np.ndarray, at: np.ndarray, tables: int) -> np.ndarray:
    """Independent fingerprints (texts x tables) of each text's lower-cased words.

    A word weighs as the logarithm of its count: its occurrences 1, 2, 4, 8, ... enter. With plain counts the
    commonest words would make all long texts of a language alike.
    """
    raw = t.LOWER[buf]
    start, end, word_at = t.words(raw, at)
    words = t.byte_hasher(raw)(start, end)
    key = words + t.mix(np.repeat(np.arange(len(at) - 1), np.diff(word_at)).astype(np.uint64))
    order = np.argsort(key, kind="stable")
    place = np.arange(len(key))
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    nth = np.empty(len(key), np.int64)
    nth[order] = place - np.maximum.accumulate(np.where(new, place, 0)) + 1
    weighs = (nth & (nth - 1)) == 0
    word_at = np.concatenate([[0], np.cumsum(weighs)])[word_at]
    words = words[weighs]
    out = np.zeros((len(at) - 1, tables), np.int64)
    some = np.flatnonzero(np.diff(word_at))
    step = 1 << 17
    for k in range(tables):
        keyed = t.mix(words + np.uint64(k * 0x632BE59BD9B4E019 % (1 << 64)))
        ones = np.zeros((len(at) - 1, BITS), np.int64)
        for low in range(0, len(words), step):
            part = keyed[low : low + step]
            inside = some[(word_at[some] < low + len(part)) & (word_at[some + 1] > low)]
            begin = np.maximum(word_at[inside] - low, 0)
            ones[inside] += np.add.reduceat(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), begin, axis=0, dtype=np.int32)
        set_bits = ones * 2 > np.diff(word_at)[:, None]
        out[:, k] = np.packbits(set_bits, axis=1, bitorder="little").view(np.int64).ravel()
    return out


def shingle_sets(buf: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's lower-cased word shingles, repeats included, and the offset of each text; of a text with fewer words, the whole sequence is one."""
    raw = t.LOWER[buf]
    start, end, word_at = t.words(raw, at)
    n = np.diff(word_at)
    counts = np.where(n >= size, n - size + 1, n > 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    begin = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - word_at[:-1], counts)
    return t.Hasher(t.byte_hasher(raw)(start, end))(begin, begin + np.repeat(np.minimum(n, size), counts)), offsets


def band_keys(buf: np.ndarray, at: np.ndarray, size: int, bands: int, rows: int) -> np.ndarray:
    """MinHash keys (texts x bands) of each text's word shingles.

    Texts without words agree in all. Two texts of similarity s agree in a band with a probability of s ** rows.
    """
    shingles, offsets = shingle_sets(buf, at, size)
    n = len(at) - 1
    some = np.flatnonzero(np.diff(offsets))
    factors = np.random.RandomState(20240711).randint(1, 1 << 62, (bands, rows), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    keys = np.empty((n, bands), np.int64)
    for k in range(bands):
        key = np.full(n, k, np.uint64)
        for factor in factors[k]:
            least = np.full(n, ~np.uint64(0))
            if len(some):
                least[some] = np.minimum.reduceat(shingles * factor, offsets[some])
            key = t.mix((key ^ least) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        keys[:, k] = key.view(np.int64)
    return keys


def odd_sketches(buf: np.ndarray, at: np.ndarray, size: int) -> tuple[list[int], list[bytes]]:
    """Size of each text's shingle set, and for each value of a shingle's low bits whether an odd number of the set has it.

    Two sketches differ in no more bits than the sets have shingles of their own, so they bound the similarity from above, whatever the hashes.
    A sketch has four bits a shingle, at least SKETCH_BITS[0] and at most SKETCH_BITS[1]; put together by XOR, its halves are the sketch of half the length.
    """
    shingles, offsets = shingle_sets(buf, at, size)
    sizes, sketches = [], []
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        own = np.unique(shingles[low:high])
        bits = min(max(SKETCH_BITS[0], 1 << (4 * len(own)).bit_length()), SKETCH_BITS[1])
        odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        sizes.append(len(own))
        sketches.append(np.packbits(odd.astype(bool)).tobytes())
    return sizes, sketches


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch (64-bit words) at a shorter length."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def possible(sizes_a: list[int], sketches_a: list[bytes], sizes_b: list[int], sketches_b: list[bytes], least: float) -> np.ndarray:
    """Which texts of a (rows) may have a similarity of `least` with those of b (columns): never false for a pair that has it."""
    own = (1 - least) / (1 + least)  # sets of similarity s have (1 - s) / (1 + s) of their sizes' sum in one only
    out = np.zeros((len(sizes_a), len(sizes_b)), bool)
    of = np.array([len(x) // 8 for x in sketches_b])
    sizes_b = np.array(sizes_b)
    for words in np.unique(of):
        at = np.flatnonzero(of == words)
        matrix = np.frombuffer(b"".join(sketches_b[i] for i in at), np.uint64).reshape(len(at), words)
        shorter = {words: matrix}
        for i, (n, sketch) in enumerate(zip(sizes_a, sketches_a)):
            mine = np.frombuffer(sketch, np.uint64)
            w = min(words, len(mine))
            if w not in shorter:
                shorter[w] = np.bitwise_xor.reduce(matrix.reshape(len(at), -1, w), axis=1)
            differ = np.bitwise_count(shorter[w] ^ folded(mine, w)).sum(axis=1, dtype=np.int64)
            out[i, at] = np.maximum(differ, np.abs(sizes_b[at] - n)) <= own * (sizes_b[at] + n) + 1e-6
    return out


def similarity(a: str, b: str, shingle: int = 5) -> float:
    """Jaccard similarity of the sets of word shingles; of a text with fewer words, the whole sequence is one."""
    sets = []
    for x in (a, b):
        raw = t.LOWER[np.frombuffer(x.encode(), np.uint8)]
        start, end, _ = t.words(raw, np.array([0, len(raw)]))
        codes = t.byte_hasher(raw)(start, end)
        sets.append(np.unique(t.Hasher(codes).windows(min(shingle, max(len(codes), 1)))))
    both = len(np.intersect1d(*sets, assume_unique=True))
    whole = len(sets[0]) + len(sets[1]) - both
    return both / whole if whole else 1.0


def deduplicated(docs: DataFrame, text: str = "text", id: str = "doc_id", tables: int = 6, radius: int = 2, shingle: int = 5, least: float = 0.8, bands: int = 24, band_rows: int = 4) -> DataFrame:
    """The rows without near copies: of each group the one with the least id stays.

    Candidates meet in any of `tables` independent fingerprints of words or in any of `bands` MinHash bands of
    word shingles (a pair of similarity 0.8 misses all 24 bands with a probability of 3e-6); each is verified by the
    similarity of word shingles, unless a bound from their sketches rules that out (see odd_sketches; no pair at `least` is lost). All members of a
    band's group are compared but for those in one component: first all with one member, then those outside the group's main
    component with all others, blocks of sketches with blocks, so that only pairs the bound leaves become rows. Null and empty texts are one group.
    Rows equal in every column count as one.
    """
    names, tables_ = docs.columns, Scratch(docs.sparkSession)
    saved = tables_.saved
    key = row_key(*names)
    node = F.unhex(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))).alias("node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in t.slices(batches, text):
            buf, at = t.utf8(t.column(batch, text))
            keys = [pa.array(list(x), pa.list_(pa.int64())) for x in (word_fingerprints(buf, at, tables), band_keys(buf, at, shingle, bands, band_rows))]
            rest = [t.column(batch, c) for c in ("id", "row_a", "row_b", "node")]
            yield pa.RecordBatch.from_arrays([*rest, *keys], names=["id", "row_a", "row_b", "node", "prints", "bands"])

    keyed = docs.select(F.col(id).alias("id"), *key, node, F.col(text).alias(text))
    rows = saved(keyed.mapInArrow(run, t.arrow_type(keyed.drop(text), "prints array<long>, bands array<long>")))
    # one row stands for all copies of a text
    texts = saved(rows.groupBy("node").agg(F.first("prints").alias("prints"), F.first("bands").alias("bands"), F.min(F.struct("row_a", "row_b")).alias("at")))
    found = []
    for k in range(tables):  # one after the other: the variants of one table at a time take room
        spread = texts.select("node", F.col("prints")[k].alias("simhash"))
        classes = saved(spread.groupBy("simhash").agg(F.min("node").alias("rep"), F.count("*").alias("n")))
        to_rep = spread.join(classes.filter("n > 1"), "simhash").select(F.col("rep").alias("a"), F.col("node").alias("b"))
        linked = links(classes, radius).alias("l").join(classes.alias("x"), F.expr("l.a = x.simhash")).join(classes.alias("y"), F.expr("l.b = y.simhash"))
        found.append(saved(to_rep.union(linked.select("x.rep", "y.rep")).filter("a <> b")))
        del linked, to_rep
        tables_.discard(classes)
        release(docs)
    spread = texts.select("node", F.explode("bands").alias("key"))
    groups = saved(spread.groupBy("key").agg(F.min("node").alias("rep"), F.count("*").alias("n")).filter("n > 1"))
    members = saved(spread.join(groups, "key"))
    found.append(members.filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")))
    # texts that meet others: all that any pair can need
    ends = reduce(DataFrame.union, found[:-1]).select(F.explode(F.array("a", "b")).alias("node")).union(members.select("node")).distinct()
    ends = saved(texts.join(ends, "node").select("node", "at.*"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in t.slices(batches, "x"):
            sizes, sketches = odd_sketches(*t.utf8(t.column(batch, "x")), shingle)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], names=["node", "x", "size", "sketch"])

    whole = docs.select(*key, F.col(text).alias("x")).join(ends, ["row_a", "row_b"]).groupBy("node").agg(F.first("x").alias("x"))
    whole = saved(whole.mapInArrow(sketched, t.arrow_type(whole, "size long, sketch binary")))
    tables_.discard(groups, ends, texts)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similarity(p or "", q or "", shingle) >= least for p, q in zip(t.column(batch, "xa").to_pylist(), t.column(batch, "xb").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(*(t.column(batch, c).to_pylist() for c in ("na", "sa", "nb", "sb")))
            ok = [bool(possible([na], [sa], [nb], [sb], least)[0, 0]) for na, sa, nb, sb in each]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, others in zip(*(t.column(batch, c) for c in ("mine", "others"))):
                sides = [[side.values.field(c).to_pylist() for c in ("node", "root", "size", "sketch")] for side in (mine, others)]
                (a, root_a, *sketch_a), (b, root_b, *sketch_b) = sides
                code = {r: i for i, r in enumerate(dict.fromkeys(root_a + root_b))}
                apart = np.array([code[r] for r in root_a])[:, None] != np.array([code[r] for r in root_b])
                i, j = np.nonzero(possible(*sketch_a, *sketch_b, least) & apart)
                yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in i], pa.binary()), pa.array([b[k] for k in j], pa.binary())], names=["a", "b"])

    def sided(pairs: DataFrame, **columns: str) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(whole.select(F.col("node").alias(side), *(F.col(c).alias(f"{short}{side}") for short, c in columns.items())), side)
        return pairs

    def near(pairs: DataFrame) -> DataFrame:
        out = saved(sided(pairs, x="x").mapInArrow(verify, "a binary, b binary"))
        tables_.discard(pairs)
        return out

    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    pairs = saved(reduce(DataFrame.union, found).select(*ordered).distinct())
    tables_.discard(*found)
    edges = near(saved(sided(pairs, n="size", s="sketch").mapInArrow(bounded, "a binary, b binary")))
    tables_.discard(pairs)
    roots = components(edges)
    release(docs)
    # every pair of two components of a group has a member outside the group's main component. A first round asks one block only: who finds
    # a link there has joined, and needs none of its other links; the second asks all blocks, and would be whole without the first
    larger = members.filter("n > 2").select("key", "node", F.ceil(F.col("n") / COMPARED).alias("blocks"))
    larger = larger.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    for last in (False, True):
        state = larger.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
        state = saved(state.select("key", "node", "blocks", "block", F.coalesce("root", "node").alias("root")))
        shares = state.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count("*").alias("parts"))
        main = saved(shares.filter("parts > 1").select("key", "main"))
        if main.isEmpty():
            break
        carried = state.join(main, "key").join(whole.select("node", "size", "sketch"), "node")
        packed = lambda df: df.groupBy("key", "block", "blocks").agg(F.collect_list(F.struct("node", "root", "size", "sketch")).alias("side"))
        others = saved(packed(carried if last else carried.filter("block = 0")))  # COMPARED members a row on average
        asking = packed(carried.filter("root <> main")).withColumn("asked", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)) if last else F.lit(0).cast("long"))
        met = asking.select("key", F.col("asked").alias("block"), F.col("side").alias("mine")).join(others.select("key", "block", F.col("side").alias("others")), ["key", "block"])
        pairs = saved(met.select("mine", "others").mapInArrow(compared, "a binary, b binary").select(*ordered).distinct())
        more = near(pairs)
        tables_.discard(state, main, others)
        if not more.isEmpty():
            edges = edges.union(more)
            roots = components(edges)
        release(docs)
    member = rows.join(roots, rows.node == roots.node, "left").select(rows.id.alias("id"), "row_a", "row_b", F.coalesce("root", rows.node).alias("root"))
    stay = member.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_a", "row_b")).alias("m")).select("m.row_a", "m.row_b")
    stay = saved(stay)
    tables_.discard(but=stay)  # the next stages need the room
    kept = docs.select(F.struct(*names).alias("_doc"), *key).join(stay, ["row_a", "row_b"])
    return kept.dropDuplicates(["row_a", "row_b"]).select("_doc.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLE_SQL: dict[str, str] = {}
