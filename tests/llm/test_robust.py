"""Odd inputs for all corpus operators, and brute-force versions of what SQL can't express."""

from __future__ import annotations

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import byte_repeats, fm_index, hilbert_sharding, line_crf, line_runs, pfair_mixing, quality_rules, simhash, tag_paths, word_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "A long paragraph, with marks; and more. And more of it, as articles have, sentence after sentence, until it is long enough to be one."


def model(width: int = 39) -> line_crf.Crf:
    rng = np.random.RandomState(2)
    return line_crf.Crf(rng.randn(width) / 4, rng.randn(2, 2) / 2, 3.0, -1.0)


def operators(bench):
    """Every operator as a function of documents, with the columns that it adds or replaces."""
    return {
        "sharding": (hilbert_sharding.sharded, ("hilbert", "position", "shard", "slot")),
        "fm_index": (lambda d: fm_index.contaminated(d, bench), ("n_words", "n_hit", "items", "spans")),
        "byte_repeats": (byte_repeats.deduplicated, ("kept", "n_bytes", "n_removed", "n_spans")),
        "line_runs": (line_runs.deduplicated, line_runs.NEW),
        "line_crf": (lambda d: line_crf.scored(d, model()), ("score",)),
        "pfair": (pfair_mixing.scheduled, pfair_mixing.NEW),
        "quality": (quality_rules.judged, ("n_words", *quality_rules.VERDICT)),
        "word_repeats": (word_repeats.deduplicated, ("kept", "n_words", "n_removed")),
    }


NAMES = tuple(operators(None))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([("a", "w1 w2 w3"), (None, None), ("b", "")], "item_id string, text string")


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_nulls_ties_and_long_texts(spark, bench, name):
    run, new = operators(bench)[name]
    rng = random.Random(4)
    long = "\n".join(" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 12))) for _ in range(4000))
    rows = [(1, long, "en", "s", 5), (2, "a b\nc", None, None, None), (2, "a b\nc", None, None, None), (3, None, "de", "s", None), (None, "", None, "t", 0), (None, None, None, None, None), (4, "x" * 30000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    clashing = docs.withColumns({c: F.lit("old") for c in new}).withColumn("row_a", F.lit("mine")).withColumn("i", F.lit("too"))
    got, plain = run(clashing), run(docs)
    assert len(set(got.columns)) == len(got.columns) and {"row_a", "i", *new} <= set(got.columns)
    shown = lambda df: Counter(repr([r[c] for c in ("doc_id", "text", *new)]) for r in df.collect())
    out = shown(got)
    if name != "pfair":  # equal rows follow each other in any order
        assert out == shown(plain)
    assert sum(out.values()) == len(rows) and not any("'old'" in x for x in out)
    assert {(r.row_a, r.i) for r in got.select("row_a", "i").collect()} == {("mine", "too")}


def test_clusters_of_clashing_columns_and_ties(spark):
    rows = [(1, "a b c d", "x"), (2, "A B c d", None), (2, "A B c d", None), (3, None, "y"), (None, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumns({"simhash": F.lit("old"), "row_a": F.lit("mine")})
    got = Counter((r.doc_id, r.component_id) for r in simhash.clusters(docs).collect())
    assert got == {(1, 1): 1, (2, 1): 2, (3, 3): 1, (None, 3): 1}


def test_classifier_on_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    assert line_crf.scored(none, line_crf.train(none, labels)).count() == 0


def test_rows_equal_in_id_and_text_stay_cheap(spark):
    text = " ".join(f"w{i % 97}x{i % 89}" for i in range(300))
    docs = spark.createDataFrame([(7, text, "en", "s", 1)] * 600 + [(9, text, "en", "s", 1)], SCHEMA)
    got = Counter((r.doc_id, r.n_removed) for r in word_repeats.deduplicated(docs).collect())
    assert got == {(7, 0): 600, (9, 300): 1}
    assert Counter((r.doc_id, r.n_removed) for r in byte_repeats.deduplicated(docs).collect()) == {(7, len(text)): 600, (9, len(text)): 1}


# 6 pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p>hello <a title="x>link</a> world</p>', "hello"),
        ("<p>it's <a title='a\"b' href=foo>it's</a> <b>bold</b></p>", "it's it's bold"),
        (f'<div id="main"><h1>T</h1><p>{LINE} {LINE}</p><p>{LINE}</p><div class="r9"><p>Great post!</p><p>Love it!</p></div></div>', f"T\n{LINE} {LINE}\n{LINE}"),
        (f"<article><h1>T</h1><p>{LINE} {LINE}</p><ul><li><a href=x>Buy now</a></li><li><a>Home</a></li></ul><p>{LINE}</p></article>", f"T\n{LINE} {LINE}\n{LINE}"),
        (f"<article><h1>T</h1><p>Short, it is.</p><ul><li>{LINE}</li><li>{LINE}</li></ul><p>Bye, all.</p></article>", f"T\nShort, it is.\n{LINE}\n{LINE}\nBye, all."),
        (f'<div class="header-wrap"><article><h1>T</h1><p>{LINE}</p></article></div><div class="comments"><p>{LINE} {LINE}</p></div>', f"T\n{LINE}"),
        (f"<article><p>{LINE}</p><pre>code = 1</pre><table><tr><td>1<td>2<tr><td>3</table><blockquote>Said so.</blockquote></article>", f"{LINE}\ncode = 1\n1\n2\n3\nSaid so."),
        ("<div>" * 50000 + "x, y.", "x, y."),
        ("<p>a, b.</i></b>" + "</div>" * 50000, "a, b."),
    ],
)
def test_page_parts(page, text):
    assert tag_paths.main_text(page) == text


def test_path_values_by_hand():
    rng = random.Random(6)
    for _ in range(20):
        blocks = [(rng.randrange(4), rng.randrange(1, 300), rng.randrange(9)) for _ in range(rng.randrange(1, 30))]
        of = lambda p: [b for b in blocks if b[0] == p]
        ratio = {p: sum(b[1] for b in of(p)) / len(of(p)) for p, _, _ in blocks}
        points = {p: (sum(b[2] for b in of(p)) + 1) / len(of(p)) for p, _, _ in blocks}
        near = []
        for k in range(len(blocks)):
            around = [blocks[j][0] for j in (k - 1, k, k + 1) if 0 <= j < len(blocks)] if len(blocks) > 2 else None
            near.append(None if around is None else (np.mean([ratio[p] for p in around]) * np.mean([points[p] for p in around])) ** 0.5)
        got = tag_paths.path_values(blocks, 1)
        assert set(got) == set(ratio)
        if len(blocks) > 2:
            for p in ratio:
                mean = np.mean([f for b, f in zip(blocks, near) if b[0] == p])
                assert got[p] == pytest.approx((mean * (ratio[p] * points[p]) ** 0.5) ** 0.5)


def test_repeated_pages(spark):
    page = f"<nav><a>x</a></nav><article><p>{LINE}</p></article>"
    pages = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, page)], "page_id long, url string, html string")
    assert Counter(r.text for r in tag_paths.extracted(pages).collect()) == {LINE: 3}


# 7 classifier


def test_score_is_the_length_weighted_mean_of_the_marginals():
    crf, text = model(), "One line, here.\n\nAnother one with MORE\n### | | |\n".encode()
    features, at, size = line_crf.line_features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert size.tolist() == [len(x) for x in text.split(b"\n") if x]
    weight = {}
    for k in range(1 << len(size)):
        y = [k >> i & 1 for i in range(len(size))]
        weight[tuple(y)] = np.exp(sum(y[i] * (features[i] @ crf.weights) for i in range(len(size))) + sum(crf.pairs[a, b] for a, b in zip(y, y[1:])))
    good = [sum(w for y, w in weight.items() if y[i]) / sum(weight.values()) for i in range(len(size))]
    mean = sum(g * n for g, n in zip(good, size)) / sum(size)
    assert crf.scores(features, at, size)[0] == pytest.approx(1 / (1 + np.exp(-(3 * mean - 1))))


# 8 mixing


def simulated(blocks: dict[str, int], weights: dict[str, float]) -> list[str]:
    """Earliest deadline first, slot by slot, in exact fractions; a stretch ends with the slot in which a source runs out."""
    left, out = {s: n for s, n in blocks.items() if n}, []
    while left:
        total = sum(Fraction(weights[s]) for s in left)
        share = {s: Fraction(weights[s]) / total for s in left}
        given, slot = dict.fromkeys(left, 0), 0
        while all(given[s] < left[s] for s in left):
            ready = [s for s in left if given[s] // share[s] <= slot]
            s = min(ready, key=lambda s: (-(-(given[s] + 1) // share[s]), s))
            out.append(s)
            given[s] += 1
            slot += 1
        left = {s: n - given[s] for s, n in left.items() if n > given[s]}
    return out


def test_slots_are_those_of_a_simulation(spark):
    rng = random.Random(8)
    rows = [(i, f"t{i}", "en", rng.choice(["a", "b", "b", "c", "c", "c", "c", None]), 1) for i in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    weights = {"a": 4.0, "b": 2.0, "c": 1.0}
    counts = Counter("\0none" if r[3] is None else r[3] for r in rows)
    want = simulated({s: -(-n // 8) for s, n in counts.items()}, weights | {"\0none": 1.0})
    got = {r.slot: r.source for r in pfair_mixing.scheduled(docs, weights, block_rows=8).collect()}
    assert [got[k] for k in range(len(got))] == [None if s == "\0none" else s for s in want]


def test_deviation_from_the_asked_weights_stays_below_a_block():
    blocks, weights = {"big": 90_000, "small": 10_000}, {"big": 0.9, "small": 0.1}
    slots = sorted((x, s) for s, _, chunk in pfair_mixing.slots_of(blocks, weights) for x in chunk)
    assert [x for x, _ in slots] == list(range(100_000))
    seen = np.cumsum([s == "big" for _, s in slots])
    assert np.abs(seen - 0.9 * np.arange(1, 100_001)).max() < 1 + 1e-6


# 9 rules


def test_posterior_against_a_plain_em():
    rng = random.Random(3)
    counts = Counter(tuple(rng.choice([0, 1, 2, 2] if rng.random() < 0.7 else [0, 0, 1]) for _ in range(3)) for _ in range(400))
    right = [[0.02, 0.20, 0.78], [0.50, 0.10, 0.40]]
    p, share, total = [[list(right[c]) for _ in range(3)] for c in (0, 1)], 0.8, sum(counts.values())
    posterior = {}
    for _ in range(200):
        old = dict(posterior)
        for v in [(a, b, c) for a in range(3) for b in range(3) for c in range(3)]:
            like = [w * p[k][0][v[0]] * p[k][1][v[1]] * p[k][2][v[2]] for k, w in ((0, share), (1, 1 - share))]
            posterior[v] = like[0] / sum(like)
        if old and max(abs(old[v] - posterior[v]) for v in posterior) < 1e-10:
            break
        for k in (0, 1):
            for r in range(3):
                seen = [sum(n * (posterior[v] if k == 0 else 1 - posterior[v]) for v, n in counts.items() if v[r] == x) + 0.02 * total * right[k][x] for x in range(3)]
                p[k][r] = [s / sum(seen) for s in seen]
        share = (sum(n * posterior[v] for v, n in counts.items()) + 0.8 * 0.02 * total) / (total * 1.02)
    fitted = quality_rules.fit(list(counts.items()), 3)
    assert all(fitted[v] == pytest.approx(posterior[v], abs=1e-6) for v in posterior)


# the pipeline


def test_pipeline_on_odd_tables(spark, bench, tmp_path):
    import corpus_pipeline

    rows = [(i, f"{LINE} Number {i} of them, told apart by {' '.join(f'z{i}q{k}' for k in range(60))}.", "en", "s", 1) for i in range(6)]
    rows += [rows[0], (50, rows[0][1], None, None, None), (51, None, "en", "s", None), (None, "", None, None, None), (None, rows[1][1], None, "t", 3)]
    for name, some in (("full", rows), ("empty", [])):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert sorted(r.text for r in got) == sorted({r[1] for r in some if r[1]})


# stage functions


@pytest.mark.parametrize("name", ["filtered", "deduplicated", "decontaminated", "mixed"])
def test_stage_functions_leave_clashing_columns_alone(spark, bench, name):
    run = {"filtered": quality_rules.filtered, "deduplicated": simhash.deduplicated, "decontaminated": lambda d: fm_index.decontaminated(d, bench), "mixed": pfair_mixing.mixed}[name]
    mine = [c for _, new in operators(bench).values() for c in new] + ["row_a", "row_b", "node", "id", "x", "i", "spans", "items", "code", "posterior", "_n", "at", "root"]
    mine = list(dict.fromkeys(mine))
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "en", "s", 5), (2, text + " w1 w2 w3 more", "en", None, None), (3, " ".join(f"other{i}" for i in range(30)), None, "t", 1)], SCHEMA).withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id")) for c in mine})
    got = run(docs)
    assert got.columns[: len(docs.columns)] == docs.columns and len(set(got.columns)) == len(got.columns)
    rows = got.collect()
    assert {r.doc_id for r in rows} >= {1, 3} and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in mine)
