"""Corpus operators against brute force, and on nulls, empty tables, ties and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldloom.llm import _anchors, _automata, _levels, _text as t
from fieldloom.llm import byte_repeats, fm_index, hilbert_sharding, line_crf, line_runs, pfair_mixing, quality_rules, simhash, tag_paths, word_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def corpus(seed: int = 1, n: int = 60):
    rng = random.Random(seed)
    vocabulary = ["The", "über", "a", "räu", "ber", "naïve", "x1", "Zeit", "ok", "日本", "so", "to", "it", "wörd"]
    words = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "x", ",", "."]) for _ in range(k))
    shared = words(130)
    rows = []
    for i in range(n):
        text = "\n".join(words(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 9)))
        if i % 5 == 0:
            text += " " + shared[rng.randrange(200) :]
        if i % 11 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1]
        rows.append((i, text, "en", f"s{i % 3}", len(text or "")))
    rows += [(900, None, None, None, None), (901, "", "en", "s0", 0), (902, " \n\t ", None, "s1", 4), (903, "one", "de", None, 3), (None, "no id at all\nno id at all", "en", "s0", 25)]
    rows += [rows[3], rows[3]]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_hashes_do_not_depend_on_the_place():
    a, b = b"abcdefgh" * 9, b"xx" + b"abcdefgh" * 9
    hash_of = lambda x, s, e: t.byte_hasher(np.frombuffer(x, np.uint8))(np.array([s]), np.array([e]))[0]
    assert hash_of(a, 0, 40) == hash_of(a, 8, 48) == hash_of(b, 2, 42) != hash_of(a, 1, 41)


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["abc", None, "", "x" * 50, "yy"])], names=["text"])
    got = [x for part in t.slices(iter([batch]), "text", 4) for x in part.column(0).to_pylist()]
    assert got == batch.column(0).to_pylist()


def test_anchors_are_the_same_for_equal_windows():
    rng = np.random.RandomState(2)
    core = rng.randint(97, 100, 90).astype(np.uint8)
    found = []
    for n in (0, 13, 40):
        buf = np.concatenate([rng.randint(97, 123, n).astype(np.uint8), core, rng.randint(97, 123, 30).astype(np.uint8)])
        anchor, first, last = _anchors.anchored(t.byte_hasher(buf), np.array([0, len(buf)]), 60, 20, 8)
        of = {p: a for a, f, e in zip(anchor, first, last) for p in range(f, e + 1)}
        assert set(of) == set(range(len(buf) - 59))
        found.append([of[n + k] - n for k in range(31)])
    assert found[0] == found[1] == found[2]


# 1 sharding


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_sharding(docs, rows, law):
    got = hilbert_sharding.sharded(docs, 4, law).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert sorted(r.position for r in got) == list(range(len(rows)))
    by = Counter(r.shard for r in got)
    for s in by:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(by[s]))
    if law == "rows":
        assert max(by.values()) - min(by.values()) <= 1
    else:
        size = lambda r: len((r.text or "").encode()) + 1
        sums = [sum(size(r) for r in got if r.shard == s) for s in range(4)]
        assert max(sums) - min(sums) <= 2 * max(size(r) for r in got)


def test_hilbert_steps_are_one(spark):
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        grid = spark.range(1 << n * bits).select(*(F.pmod(F.shiftright("id", bits * i), F.lit(1 << bits)).cast("int").alias(f"c{i}") for i in range(n)))
        path = grid.select("*", hilbert_sharding.hilbert_index([F.col(f"c{i}") for i in range(n)], bits).alias("h")).orderBy("h").collect()
        assert [r.h for r in path] == list(range(1 << n * bits))
        assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(path, path[1:]))


def test_sharding_query(spark, sf_dir):
    got = hilbert_sharding.op1_hilbert_sharding(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id for r in got} == set(texts)
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)


# 2 decontamination


def test_suffix_array():
    rng = np.random.RandomState(0)
    for n, v in ((1, 1), (60, 2), (500, 1), (700, 40)):
        s = rng.randint(0, v, n)
        assert fm_index.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("block", [16 << 20, 960])
def test_decontamination(spark, docs, rows, block):
    plain = [r[1] for r in rows if r[1] and len(ALNUM.findall(r[1])) > 25]
    items = [("a", plain[0][:120].upper()), ("b", "No, ID at"), ("b", "one"), ("c", None), ("d", " ,; "), (None, plain[1][30:160]), ("e", plain[0][:120])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows: dict = {}
    for i, x in items:
        w = ALNUM.findall(lower(x or ""))
        k = min(10, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).add(i or "null")
    want = Counter()
    for r in rows:
        w, hit, its = ALNUM.findall(lower(r[1] or "")), set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in windows:
                    hit |= set(range(p, p + k))
                    its |= windows[tuple(w[p : p + k])]
        want[(r[0], len(w), len(hit), ",".join(sorted(its)))] += 1
    found = fm_index.contaminated(docs.withColumn("items", F.lit(1)), bench, block_bytes=block)
    got = Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in found.collect())
    assert got == want and any(k[2] for k in got)
    left = {r.doc_id: r for r in fm_index.decontaminated(docs, bench, block_bytes=block).collect()}
    clean = {k[0] for k in want if not k[2]}
    assert all(left[r[0]].text == r[1] for r in rows if r[0] in clean) and 903 not in left
    assert fm_index.contaminated(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


# 3 and 10 repeats


def byte_reference(texts, size):
    starts = Counter(x[i : i + size] for x in texts for i in range(len(x) - size + 1))
    out = []
    for x in texts:
        gone = bytearray(len(x))
        for i in range(len(x) - size + 1):
            if starts[x[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for k in range(len(x)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(x), sum(gone), spans, bytes(c for c, g in zip(x, gone) if not g)))
    return out


def test_levels_merge_geometrically(spark):
    family = _levels.SuffixLevels()
    parts = [[1, 2, 2], [3, 1], [4], [5], [4, 6], [7], [8, 9, 9]]
    found = [sorted(r.core for r in family.add(spark.createDataFrame([(c,) for c in p], "core long")).collect()) for p in parts]
    assert found == [[2], [1], [], [], [4], [], [9]]
    assert [n for n, _, _ in family.levels] == [4, 2, 1]
    assert sum(table.agg(F.sum("n")).first()[0] for _, table, _ in family.levels) == sum(map(len, parts))


@pytest.mark.parametrize(("size", "batches"), [(40, 3), (100, 4)])
def test_byte_repeats(docs, rows, size, batches):
    want = Counter((r[0], *w) for r, w in zip(rows, byte_reference([(r[1] or "").encode() for r in rows], size)))
    got = byte_repeats.deduplicated(docs, size=size, batches=batches)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == want


def test_automaton_statistics():
    rng = random.Random(3)
    for _ in range(40):
        added = [[rng.randrange(3) for _ in range(rng.randrange(12))] for _ in range(3)]
        asked = [rng.randrange(3) for _ in range(15)]
        automaton = _automata.SuffixAutomaton()
        for x in added:
            automaton.add(x)
        runs = {tuple(x[a:b]) for x in added for a in range(len(x)) for b in range(a, len(x) + 1)} | {()}
        assert list(automaton.statistics(asked)) == [max(k for k in range(e + 2) if tuple(asked[e + 1 - k : e + 1]) in runs) for e in range(len(asked))]


@pytest.mark.parametrize(("size", "automata"), [(8, 256), (20, 256), (8, 2), (8, 0)])
def test_word_repeats(docs, rows, size, automata):
    key = lambda r: -(1 << 63) if r[0] is None else r[0]
    first: dict = {}
    for r in sorted(rows, key=key):
        w = SPACE.findall(r[1] or "")
        for p in range(len(w) - size + 1):
            first.setdefault(tuple(w[p : p + size]), key(r))
    want = Counter()
    for r in rows:
        w = SPACE.findall(r[1] or "")
        gone = set()
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < key(r):
                gone |= set(range(p, p + size))
        want[(r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    got = word_repeats.deduplicated(docs, size=size, automata=automata)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == want


# 4 lines


def line_reference(rows, run):
    """Lines that go and maximal repeated runs, by comparing every suffix with all that come before it."""
    distinct = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0]))
    suffixes, longest = [], {}
    for i, x in distinct:
        lines = x.split("\n")
        for p in range(len(lines)):
            agree = lambda q, r, lines=lines, p=p: next((k for k in range(min(len(lines) - p, len(q) - r)) if lines[p + k] != q[r + k]), min(len(lines) - p, len(q) - r))
            longest[i, p] = max((agree(q, r) for q, r in suffixes), default=0)
            suffixes.append((lines, p))
    want = Counter()
    for r in rows:
        lines = [] if r[1] is None else r[1].split("\n")
        size = [longest[r[0], p] if longest[r[0], p] >= run else 0 for p in range(len(lines))]
        gone = {k for p, n in enumerate(size) for k in range(p, p + n)}
        kept = None if r[1] is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        want[(r[0], kept, len(gone), sum(1 for p, n in enumerate(size) if n and (p == 0 or size[p - 1] <= n)))] += 1
    return want


@pytest.mark.parametrize("run", [1, 2, 3])
def test_line_runs(docs, rows, run):
    got = line_runs.deduplicated(docs.withColumn("kept", F.lit(0)), min_run=run)
    assert counted(got, "doc_id", "kept", "n_removed", "n_runs") == line_reference(rows, run)


def test_line_runs_are_maximal_repeats(spark):
    texts = ["a\nb\nq", "r\nb\nc", "a\nb\nc", "x\n" * 40, "y\nx\nx\nx", "a\nb\nq\nr\nb\nc"]
    rows = [(i, x, "en", "s", 1) for i, x in enumerate(texts)]
    got = line_runs.deduplicated(spark.createDataFrame(rows, SCHEMA), min_run=2)
    assert counted(got, "doc_id", "kept", "n_removed", "n_runs") == line_reference(rows, 2)
    assert {r.doc_id: r.n_runs for r in got.collect()}[2] == 2  # a b of one document and b c of another


def test_line_runs_of_random_lines(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice("ab") for _ in range(rng.randrange(30))), "en", "s", 1) for i in range(12)]
    got = line_runs.deduplicated(spark.createDataFrame(rows, SCHEMA))
    assert counted(got, "doc_id", "kept", "n_removed", "n_runs") == line_reference(rows, 2)


# 5 near copies


def test_simhash_components(docs, rows):
    prints = []
    for r in rows:
        w = SPACE.findall(lower(r[1] or ""))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        bits = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
        prints.append(sum(1 << b for b in range(64) if bits[b] * 2 > len(shingles)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    want = Counter((r[0], p, least[g]) for r, p, g in zip(rows, prints, group))
    got = simhash.clusters(docs)
    assert Counter((r.doc_id, r.simhash % (1 << 64), r.component_id) for r in got.collect()) == want


def test_links_of_a_chain(spark):
    chain = [0, 3, 15, 63, 255, (1 << 63), (1 << 63) + 3]
    prints = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in chain], "simhash long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(prints)).collect()}
    assert len({roots[c] for c in (0, 3, 15, 63, 255)}) == 1 and len(set(roots.values())) == 1  # 0 and 1 << 63 differ in one bit
    with pytest.raises(ValueError):
        simhash.links(prints, 3)


def test_deduplicated_keeps_one_of_each_group(spark):
    rng = random.Random(7)
    make = lambda: [f"w{rng.randrange(900)}" for _ in range(200)]
    base, rows = make(), []
    for i in range(6):
        near = list(base)
        near[20 * i] = "changed"
        rows.append((10 + i, " ".join(near), "en", "s", 1))
    rows += [(i, " ".join(make()), "en", "s", 1) for i in range(5)] + [(30, None, "en", "s", 0), (31, "", "en", "s", 0), (10, rows[0][1], "en", "s", 1)]
    kept = sorted(r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect())
    assert kept[:5] == [0, 1, 2, 3, 4] and kept.count(10) == 1 and kept.count(30) == 1 and 31 not in kept
    assert sum(10 <= k <= 15 for k in kept) <= 2


def kept_by_brute_force(texts):
    """The least index of each component of all pairs at 0.8 or more."""
    sets = []
    for x in texts:
        w = x.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return sorted(set(group))


def test_deduplicated_finds_all_pairs_with_blocks_added_or_cut(spark):
    rng = random.Random(11)
    make = lambda n: [f"w{rng.randrange(2000)}" for _ in range(n)]
    texts = []
    for _ in range(40):
        base = make(rng.randrange(150, 400))
        n, at = len(base), rng.randrange(len(base))
        texts += [base, base[:at] + make(n * 18 // 100) + base[at:], base[n // 7 :]]
    texts = [" ".join(x) for x in texts]
    want = kept_by_brute_force(texts)
    got = simhash.deduplicated(spark.createDataFrame([(i, x, "en", "s", 1) for i, x in enumerate(texts)], SCHEMA))
    assert sorted(r.doc_id for r in got.collect()) == want and len(want) < 60


@pytest.mark.parametrize("block", [256, 7])
def test_deduplicated_compares_all_of_a_group(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "COMPARED", block)
    rng = random.Random(12)
    make = lambda n: [f"w{rng.randrange(2000)}" for _ in range(n)]
    texts = []
    for _ in range(12):  # the copies share a group with texts that are like them, but under 0.8
        base = make(300)
        texts += [base, base[:100] + make(55) + base[100:]] + [base[:k] + make(90) + base[k:] for k in range(20, 280, 5)]
    texts = [" ".join(x) for x in texts]
    want = kept_by_brute_force(texts)
    got = simhash.deduplicated(spark.createDataFrame([(i, x, "en", "s", 1) for i, x in enumerate(texts)], SCHEMA))
    assert sorted(r.doc_id for r in got.collect()) == want and len(want) > 500


def test_sketches_lose_no_pair():
    rng = random.Random(13)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    texts = ["", "  ", "a b", "a b c d e f", " ".join(f"v{i}" for i in range(9000)), " ".join(f"v{i}" for i in range(8000))]
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randrange(16)):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        texts.append(" ".join(words[: rng.choice([400, 330, 250])]))
    sizes, sketches = simhash.odd_sketches(*t.utf8(pa.array(texts)), 5)
    assert len({len(x) for x in sketches}) > 2
    got = simhash.possible(sizes, sketches, sizes, sketches, 0.8)
    want = np.array([[simhash.similarity(a, b) >= 0.8 for b in texts] for a in texts])
    assert not (want & ~got).any() and (got & ~want).sum() < 0.2 * want.sum()


def test_similarity():
    assert simhash.similarity("a b c d e f", "A b c d e f") == 1.0
    assert simhash.similarity("a b", "a b") == 1.0 and simhash.similarity("", "") == 1.0 and simhash.similarity("a", "") == 0.0
    assert simhash.similarity("a b c d e f", "a b c d e g") == pytest.approx(1 / 3)


# 6 pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<script>var a = '<p>no</p>';</script>", ""),
        ("just &lt;text&gt; &amp; more", "just <text> & more"),
        ('<nav><a href="/">Home</a></nav><article><h1>Title</h1><p>First  part,\nwith <b>bold</b> words.<p>Second part, here.</article><footer>&copy; x</footer>', "Title\nFirst part, with bold words.\nSecond part, here."),
        ('<div class="menu">a b c</div><div id="main"><p>A long paragraph, with marks; and more. And more.</p><p>Another one, as long as that; with marks.</p></div><div class="comments"><p>I like this, very much, indeed!</p></div>', "A long paragraph, with marks; and more. And more.\nAnother one, as long as that; with marks."),
    ],
)
def test_pages(page, text):
    assert tag_paths.main_text(page or "") == text


def test_pages_frame(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x, y.</p>", "old"), (2, None, None, None)], "page_id long, url string, html string, text string")
    assert counted(tag_paths.extracted(pages), "page_id", "text") == Counter({(1, "x, y."): 1, (2, ""): 1})
    assert tag_paths.extracted(pages.limit(0)).count() == 0


# 7 classifier


def test_crf_marginals_match_enumeration():
    rng = np.random.RandomState(1)
    features, at = rng.randn(5, 3), np.array([0, 3, 3, 5])
    model = line_crf.Crf(rng.randn(3), rng.randn(2, 2))
    good, expected = model.marginals(features, at)
    want_pairs = np.zeros((2, 2))
    for a, b in ((0, 3), (3, 5)):
        weights = {}
        for k in range(1 << (b - a)):
            y = [k >> i & 1 for i in range(b - a)]
            weights[tuple(y)] = np.exp(sum(y[i] * (features[a + i] @ model.weights) for i in range(b - a)) + sum(model.pairs[y[i], y[i + 1]] for i in range(b - a - 1)))
        total = sum(weights.values())
        for i in range(b - a):
            assert good[a + i] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / total)
        for y, w in weights.items():
            for i in range(b - a - 1):
                want_pairs[y[i], y[i + 1]] += w / total
    assert np.allclose(expected, want_pairs)


def test_crf_held_out_accuracy(spark, sf_dir):
    got = line_crf.op7_line_crf(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got if r.held_out]) > 0.85
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_crf_without_labels(docs, spark):
    model = line_crf.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    scores = {r.doc_id: r.score for r in line_crf.scored(docs, model).collect()}
    assert scores[900] == scores[901] == scores[902] == 0.0 and scores[903] == 0.5


# 8 mixing


def test_stretches_keep_every_source_within_a_block():
    rng = random.Random(1)
    for _ in range(20):
        blocks = {f"s{i}": rng.randrange(300) for i in range(rng.randrange(1, 10))}
        plan = pfair_mixing.stretches(blocks, {s: rng.random() + 0.01 for s in blocks}, rng.choice([20, 50, 100]))
        used = {}
        for s, a, b, start, share, period, slots in plan:
            for i in range(a, b):
                slot = start + (i - a) // share * period + slots[(i - a) % share]
                assert slot not in used
                used[slot] = s
        assert sorted(used) == list(range(sum(blocks.values())))
        starts = sorted({p[3] for p in plan}) + [len(used)]
        for begin, end in zip(starts, starts[1:]):
            target = {p[0]: p[4] / p[5] for p in plan if p[3] == begin}
            got = dict.fromkeys(target, 0)
            for slot in range(begin, end):
                got[used[slot]] += 1
                assert all(abs(got[s] - w * (slot - begin + 1)) < 1 for s, w in target.items())


def test_stretches_keep_the_weights_given():
    blocks = {f"s{i:02}": 3000 if i else 12000 for i in range(20)}
    weights = {s: n**0.5 for s, n in blocks.items()}
    plan = [p for p in pfair_mixing.stretches(blocks, weights) if p[3] == 0]
    total = sum(weights.values())
    used = {slots[(i - a) % share] + (i - a) // share * period: s for s, a, b, _, share, period, slots in plan for i in range(a, b)}
    assert sorted(used) == list(range(len(used))) and len(used) > 30000
    got = dict.fromkeys(weights, 0)
    for slot in range(len(used)):
        got[used[slot]] += 1
        assert all(abs(got[s] - w * (slot + 1) / total) < 1 + 1e-6 for s, w in weights.items())


def test_mixing_keeps_all_rows(docs, rows):
    got = pfair_mixing.scheduled(docs, {"s0": 3.0, "s1": 1.0}, block_rows=4).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert len({(r.slot, r.offset) for r in got}) == len(rows)
    assert len({(r.slot, r.source) for r in got}) == len({r.slot for r in got})
    assert Counter((r.doc_id, r.text) for r in pfair_mixing.mixed(docs).collect()) == Counter((r[0], r[1]) for r in rows)


def test_mixing_takes_any_number_of_sources(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 700}" if i < 2000 else "hot", 1) for i in range(3000)]
    many = spark.createDataFrame(rows, SCHEMA)
    for weights in (None, {"s699": 5.0, "hot": 9.0}):
        got = pfair_mixing.scheduled(many, weights).collect()
        assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[3]) for r in rows)
        assert len({(r.slot, r.offset) for r in got}) == len(rows) and {r.slot for r in got} == set(range(max(r.slot for r in got) + 1))
        hot = [r.slot for r in got if r.source == "hot"]
        assert {r.source for r in got if r.slot in set(hot)} == {"hot"}


# 9 rules


def test_quality_features(docs, rows):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judged(docs).collect())
    want = Counter()
    for r in rows:
        x = r[1] or ""
        w, places, seen, dup = SPACE.findall(x), {}, set(), 0
        for i in range(len(w) - 4):
            places.setdefault(tuple(w[i : i + 5]), []).append(i)
        again = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(5)}
        for line in x.split("\n"):
            if SPACE.search(line):
                dup += line in seen
                seen.add(line)
        want[(r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), dup, len(again), len(w) < 10 or 100 * len(again) > 20 * len(w))] += 1
    assert got == want


def test_posterior_tells_good_from_bad():
    good, bad = (2,) * 7, (0, 0, 2, 2, 2, 2, 2)
    fitted = quality_rules.fit([(good, 900), (bad, 100)], 7)
    assert fitted[good] > 0.9 and fitted[bad] < 0.5
    assert quality_rules.fit([], 7)[good] > 0.5


# all


def test_empty_tables(none, spark):
    bench = spark.createDataFrame([("a", "b c")], "item_id string, text string")
    for got in (
        hilbert_sharding.sharded(none), fm_index.contaminated(none, bench), fm_index.decontaminated(none, bench), byte_repeats.deduplicated(none), word_repeats.deduplicated(none),
        line_runs.deduplicated(none), simhash.clusters(none), simhash.deduplicated(none), pfair_mixing.scheduled(none), pfair_mixing.mixed(none), quality_rules.judged(none), quality_rules.filtered(none),
    ):
        assert got.count() == 0


def test_very_long_text(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60000))
    docs = spark.createDataFrame([(1, long, "en", "s", 1), (2, long[1000:200000], "en", "s", 1)], SCHEMA)
    got = {r.doc_id: r for r in word_repeats.deduplicated(docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed >= got[2].n_words - 2
    assert fm_index.contaminated(docs, spark.createDataFrame([("a", long[5000:5100])], "item_id string, text string")).filter("n_hit >= 10").count() == 2


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.run(spark, sf_dir)
    assert set(source.columns) <= set(got.columns)
    ids = [r.doc_id for r in got.collect()]
    assert len(ids) == len(set(ids)) and 0.4 * source.count() < len(ids) < source.count()


def test_target_weights_hold_in_the_rows_of_the_pipeline(spark, sf_dir):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, sf_dir).select("source", "shard", "slot", "mix").collect()
    for s in {r.shard for r in got}:
        inside = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in inside] == list(range(len(inside))) and all(a.mix < b.mix for a, b in zip(inside, inside[1:]))
    counts = Counter(r.source for r in got)
    blocks = {s: -(-n // pfair_mixing.BLOCK_ROWS) for s, n in counts.items()}
    total, seen = sum(n**0.5 for n in counts.values()), Counter()
    for k, (_, source) in enumerate(sorted({(r.mix // pfair_mixing.BLOCK_ROWS, r.source) for r in got}), 1):
        seen[source] += 1
        assert all(abs(seen[s] - k * n**0.5 / total) < 1.05 for s, n in counts.items())
        if seen[source] == blocks[source]:
            break


def test_digest():
    assert fm_index.items_digest([]) == hashlib.sha256(b"").hexdigest()
