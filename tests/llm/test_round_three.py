"""Merkle manifest, byte-pair encoding and collocations against plain versions, and on odd inputs."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import byte_pairs, collocations, merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# 11 manifest


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, lower=False) -> str:
    out = ""
    for c in merkle_manifest.COLUMNS:
        value = row[c]
        if lower and c == "text" and value is not None:
            value = value.translate(str.maketrans(merkle_manifest.UPPER, merkle_manifest.LOWER))
        out += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return h(out)


def plain_tree(digests: list[str], fanout: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and the siblings of each leaf."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        cut = lambda p: (p // fanout * fanout, min(len(digests), p // fanout * fanout + fanout))
        for path, p in zip(paths, at):
            a, b = cut(p)
            path.append(("".join(digests[a:p]), "".join(digests[p + 1 : b])))
        digests = [h(*digests[a : a + fanout]) for a in range(0, len(digests), fanout)]
        at = [p // fanout for p in at]
    return digests[0], paths


def plain_manifest(rows, fanout=16) -> Counter:
    trees = defaultdict(list)
    for r in rows:
        trees[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        trees[s].sort(key=lambda x: x[:3])
        built[s] = plain_tree([x[2] for x in trees[s]], fanout)
    root, above = plain_tree([built[s][0] for s in names], fanout)
    out = Counter()
    for s, top in zip(names, above):
        for (_, _, leaf, r), path in zip(trees[s], built[s][1]):
            path = path + top
            touched = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            at = plain_leaf(r, lower=True) if touched else leaf
            for left, right in path:
                at = h(left, at, right)
            out[(r["doc_id"], leaf, built[s][0], root, h(*(x for step in path for x in step)), at, at == root)] += 1
    return out


def manifest(docs):
    columns = {c: F.col(c) for c in merkle_manifest.COLUMNS}
    other = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle_manifest.leaf(columns | {"text": F.translate("text", merkle_manifest.UPPER, merkle_manifest.LOWER)}))
    found = merkle_manifest.proofs(docs, columns, F.col("source"), carried={"other": other}).withColumn("fold", merkle_manifest.folded(F.coalesce("other", "leaf"), F.col("path")))
    return Counter(tuple(r) for r in found.select("id", "leaf", "subroot", "root", F.sha2(merkle_manifest.proof(F.col("path")), 256), "fold", F.col("fold") == F.col("root")).collect())


@pytest.mark.parametrize("sources", [1, 3, 40])
def test_manifest(spark, sources):
    rng = random.Random(sources)
    rows = [(i, rng.choice(["Some Text", "low", "", None, "É A"]) , rng.choice(["en", None]), rng.choice(["hot", f"s{rng.randrange(sources)}", None, "é"]), rng.choice([3, None])) for i in range(700)]
    rows += [(5, "again", "en", "hot", 1), (5, "again", "en", "hot", 1), (None, "No Id", None, "hot", None), (None, None, None, "alone", None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"digest": F.lit("mine"), "place": F.lit(1), "n": F.lit("x")}).repartition(7)
    assert manifest(docs) == plain_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])


def test_manifest_of_few_rows(spark):
    assert manifest(spark.createDataFrame([], SCHEMA)) == Counter()
    one = [(15, "Only One", "en", None, 8)]
    assert manifest(spark.createDataFrame(one, SCHEMA)) == plain_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), one[0]))])
    leaf = plain_leaf(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), one[0])))
    (got,) = manifest(spark.createDataFrame(one, SCHEMA))
    assert got[1] == got[2] == got[3] == leaf and got[4] == h("")


# 12 byte pairs


@pytest.fixture(scope="module")
def vocabulary_path():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(1)
    every = ["", None, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "it's we'll 'S  \n\n x\r\n \t", "x" * 30000, "漢字かな" * 500, "\x1c\x1f a\x85b", "ab" * 60]
    for _ in range(300):
        kind, n = rng.randrange(3), rng.randrange(60)
        if kind == 0:
            every.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x3000), rng.randrange(0x10000, 0x20000)])) for _ in range(n)))
        elif kind == 1:
            every.append("".join(rng.choice("ab 's\n\t<|endoftext|>\x1c ñ漢1²") for _ in range(n)))
        else:
            every.append(rng.choice("xyαβ漢") * rng.randrange(300))
    return every


def test_byte_pairs_are_the_library_s(spark, vocabulary_path):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(vocabulary_path)
    texts = odd_texts()
    docs = spark.createDataFrame([(i, x, "mine", "too") for i, x in enumerate(texts)], "doc_id long, text string, ids string, row_a string").repartition(5)
    got = byte_pairs.with_text(byte_pairs.with_ids(docs, vocabulary_path), vocabulary_path)
    assert got.columns == ["doc_id", "text", "row_a", "ids", "decoded"]
    for r in got.collect():
        want = theirs.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == theirs.decode(want, skip_special_tokens=False) and r.row_a == "too"


def test_scanning_and_heap_merge_alike(vocabulary_path):
    v, rng = byte_pairs.Vocabulary(vocabulary_path), random.Random(2)
    for _ in range(500):
        piece = bytes(rng.choice(b"abcthein \xc3\xa9") for _ in range(rng.randrange(1, 90)))
        bounds, parts = byte_pairs.scanned(piece, v)
        assert (bounds, parts) == byte_pairs.heaped(piece, v) and [v.bytes[x] for x in parts] == [piece[a:b] for a, b in zip(bounds, bounds[1:])]


def test_decoding_odd_ids(spark, vocabulary_path):
    rows = spark.createDataFrame([(1, [50256, 64]), (2, []), (3, None), (4, [228])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in byte_pairs.with_text(rows, vocabulary_path).collect()}
    assert got == {1: "<|endoftext|>a", 2: "", 3: "", 4: "�"}
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_pairs.with_text(spark.createDataFrame([([70000],)], "ids array<int>"), vocabulary_path).collect()
    assert byte_pairs.with_ids(spark.createDataFrame([], "text string"), vocabulary_path).count() == 0


# 13 collocations


def plain_pieces(text: str | None):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    piece = [""]
    for c in low:
        if c in ".,;:!?\n\x0b\x0c\r":
            piece.append("")
        else:
            piece[-1] += c
    return [[w for w in p.replace("\t", " ").split(" ") if w] for p in piece]


def plain_counts(rows, longest):
    f = defaultdict(Counter)
    for text, lang in rows:
        for w in plain_pieces(text):
            for size in range(1, longest + 1):
                f[lang or "und"].update(" ".join(w[i : i + size]) for i in range(len(w) - size + 1))
    return f


def plain_mined(rows, longest, least, share, limit):
    out = set()
    for lang, f in plain_counts(rows, longest).items():
        n = sum(v for k, v in f.items() if " " not in k)
        candidates = {k: v for k, v in f.items() if " " in k and v >= least}
        found = []
        for k, a in candidates.items():
            if any(len(x.split(" ")) > len(k.split(" ")) and f" {k} " in f" {x} " and 100 * v >= share * a for x, v in candidates.items()):
                continue
            w = k.split(" ")
            cuts = [(1_000_000 * a * a // (f[" ".join(w[:i])] * f[" ".join(w[i:])]), i, f[" ".join(w[:i])], f[" ".join(w[i:])]) for i in range(1, len(w))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, k.encode(), left, right))
        out |= {(lang, i + 1, k.decode(), -a, left, right, n, -s) for i, (s, a, k, left, right) in enumerate(sorted(found)[:limit])}
    return out


def phrase_rows():
    rng = random.Random(3)
    some = [f"w{i}" for i in range(9)] + ["É", "a b", "A-B", "x"]
    rows = [(" ".join(rng.choice(some) + rng.choice(["", "", "", ",", ".\n", "\t", "  "]) for _ in range(rng.randrange(40))), rng.choice(["en", "en", "de", None])) for _ in range(60)]
    passage = " ".join(f"p{i}" for i in range(50))
    rows += [(f"w1 {passage} w2", "en")] * 12 + [("ring a b c " * 9, "en"), ("same same same same same", "de"), ("y y " * 40, None), (None, "en"), ("", None), (".,;", "fr"), ("One", "fr")]
    return rows


@pytest.mark.parametrize(("longest", "least", "share", "limit"), [(3, 10, 50, 2000), (3, 2, 80, 7), (4, 3, 50, 50)])
def test_collocations(spark, longest, least, share, limit):
    rows = phrase_rows()
    docs = spark.createDataFrame([(x, lang, "mine", 3) for x, lang in rows], "text string, lang string, run string, n int").repartition(6)
    got = {tuple(r) for r in collocations.mined(docs, longest=longest, least=least, share=share, limit=limit).collect()}
    assert got == plain_mined(rows, longest, least, share, limit)


def test_paths_hold_every_edge_once(spark):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "text string, lang string")
    hot = collocations.hot_nodes(docs, parts=200)
    assert hot
    known = collocations.counts(collocations.edges(docs, hot=hot), 3, 2, 200)
    known.cache()
    paths = collocations.compacted(known)
    assert paths.agg(F.max(F.size("words"))).first()[0] >= 50
    want = Counter({(lang, k): v for lang, f in plain_counts(rows, 3).items() for k, v in f.items() if k.count(" ") >= 1 and v >= 2})
    got = [(r.lang, r.run, r.n) for r in collocations.expanded(paths, known).collect()]
    assert len(got) == len({x[:2] for x in got}) and {(a, b): n for a, b, n in got} == want


def test_runs_in_stretches(monkeypatch):
    import numpy as np
    import pyarrow as pa

    text = b"a b c d e. f g\nh"
    langs = pa.array(["en"]).dictionary_encode()

    def counted():
        found = (collocations.runs(x, words, langs.dictionary) for x, words in collocations.counted(np.frombuffer(text, np.uint8), np.array([0, len(text)]), langs, 3))
        return {(" ".join(filter(None, (r["node"].split("\t")[1], r["last"]))), r["n"]) for x in found for r in x.to_pylist()}

    whole = counted()
    monkeypatch.setattr(collocations, "STEP", 2)
    assert counted() == whole == {(x, 1) for x in ("a b c", "b c d", "c d e", "d e", "e", "f g", "g", "h")}


def test_collocations_of_nothing(spark):
    assert collocations.mined(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.mined(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0
