"""op3's query at its own length of 400 bytes: what is shorter stays, however many words it has."""

from __future__ import annotations

import hashlib
import random

from fieldloom.llm.byte_repeats import op3_byte_repeats
from tests.llm.test_corpus import byte_reference


def passage(rng: random.Random, n_words: int, n_bytes: int) -> str:
    """That many words of ASCII letters with single spaces, that many bytes in all."""
    letters = n_bytes - (n_words - 1)
    sizes = [letters // n_words + (k < letters % n_words) for k in range(n_words)]
    return " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(k)) for k in sizes)


def test_only_strings_of_400_bytes_go(spark, tmp_path):
    rng = random.Random(8)
    own = lambda: passage(rng, 60, 420)
    short, under, exact = passage(rng, 59, 394), passage(rng, 52, 399), passage(rng, 52, 400)
    wide = "".join(rng.choice("éàüößñ") for _ in range(200))
    ends = iter("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    between = lambda x: f"{own()}{next(ends)}{x}{next(ends)}{own()}"
    rows = [
        *((k, between(short)) for k in range(5)),
        *((k, between(under)) for k in (10, 11)),
        *((k, between(exact)) for k in (20, 21)),
        (30, wide), (31, between(wide)),
        (40, "x" * 400), (41, "y" * 401), (50, None), (51, ""),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in op3_byte_repeats(spark, str(tmp_path)).collect()}
    want = byte_reference([(x or "").encode() for _, x in rows], 400)
    assert got == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for (i, _), w in zip(rows, want)}
    assert {i: g[1:3] for i, g in got.items() if g[1]} == {20: (400, 1), 21: (400, 1), 30: (400, 1), 31: (400, 1), 41: (401, 1)}
