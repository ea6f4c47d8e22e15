"""Quality rules by weak supervision.

Rules vote good, bad or abstain on each document. Expectation-maximisation over the
counts of all vote patterns (a table bounded by 3**rules, whatever the corpus size)
estimates how often each rule votes what in good and in bad documents; the posterior
probability of "good" then replaces the usual all-must-pass filter.

Defined results: a null text has no words, so its base check fails; rows with equal
texts get equal verdicts; other columns pass through untouched (new columns take the
names in FEATURES and VERDICT, and replace input columns so named). Texts are judged whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import _text as t
from fieldloom.llm._tables import packed, table

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_text_bytes long"
VERDICT = ("base_failed", "posterior", "kept")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 5


def measure(buf: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of FEATURES for a batch of texts."""
    start, end, word_at = t.words(buf, at)
    hashed = t.byte_hasher(buf)
    word = hashed(start, end)
    texts = np.arange(len(at) - 1)
    first = (buf & 0xC0) != 0x80
    of_word = np.repeat(texts, np.diff(word_at))

    # windows that recur in their text
    good = t.inside(word_at, WINDOW)
    begin = np.flatnonzero(good)
    key = t.Hasher(word).windows(WINDOW)[begin] + t.mix(of_word[begin].astype(np.uint64))
    again = begin[t.repeated(key)]
    n_repeat = t.per_text(t.covered(again, WINDOW, len(word)), word_at)

    # lines, split at \n alone, that hold a word and equal an earlier one
    line_start, line_end = t.runs(buf != 10, at)
    spoken = np.searchsorted(start, line_end, "left") > np.searchsorted(start, line_start, "left")
    line_start, line_end = line_start[spoken], line_end[spoken]
    of_line = t.owner(at, line_start)
    distinct = np.unique(hashed(line_start, line_end) + t.mix(of_line.astype(np.uint64)), return_index=True)[1]
    count = lambda of: np.bincount(of, minlength=len(at) - 1)
    n_lines = count(of_line)
    upper = (buf >= 65) & (buf <= 90)
    return {
        "n_words": np.diff(word_at),
        "word_chars": t.per_text(t.NOT_SPACE[buf] & first, at),
        "n_symbols": t.per_text(SYMBOLS[buf], at),
        "n_dup_lines": n_lines - count(of_line[distinct]),
        "n_repeat_words": n_repeat,
        "n_lines": n_lines,
        "n_upper": t.per_text(upper, at),
        "n_letters": t.per_text(upper | ((buf >= 97) & (buf <= 122)), at),
        "n_text_bytes": np.diff(at),
    }


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns of FEATURES to each row; no shuffle."""
    new = [x.split()[0] for x in FEATURES.split(", ")]
    docs = docs.drop(*new)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in t.slices(batches, text):
            found = measure(*t.utf8(t.column(batch, text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[c].astype(np.int64)) for c in new)], names=[*names, *new])

    return docs.mapInArrow(run, t.arrow_type(docs, FEATURES))


def base_failed(min_words: int = 10, repeat_percent: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def _per(part: str, whole: str) -> Column:
    return F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))


def rules() -> dict[str, Column]:
    """Each rule's vote: 2 good, 0 bad, 1 abstains. Every kind of junk is seen by two rules at least."""
    upto = lambda value, good, bad: F.when(value > bad, 0).when(value <= good, 2).otherwise(1)
    mean = _per("word_chars", "n_words")
    return {
        "symbols_a_word": upto(_per("n_symbols", "n_words"), 0.05, 0.1),
        "symbols_a_byte": upto(_per("n_symbols", "n_text_bytes"), 0.005, 0.02),
        "upper_case": upto(_per("n_upper", "n_letters"), 0.15, 0.3),
        "capitals_a_word": upto(_per("n_upper", "n_words"), 0.5, 1.0),
        "repeats": upto(_per("n_repeat_words", "n_words"), 0.1, 0.5),
        "repeated_lines": upto(_per("n_dup_lines", "n_lines"), 0.25, 0.5),
        "word_length": F.when((mean < 2.5) | (mean > 11), 0).when((mean >= 3) & (mean <= 9), 2).otherwise(1),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 200, prior: float = 0.8, strength: float = 0.02) -> dict[tuple[int, ...], float]:
    """Posterior probability of good for every possible vote pattern.

    Each rule has a probability of each vote in either class. They start from rules that
    are mostly right; pseudo-counts (`strength` of all rows) hold rare votes in place and
    keep the classes from swapping.
    """
    every = list(itertools.product(range(3), repeat=n_rules))
    count = dict(patterns)
    votes = np.array(every).reshape(len(every), n_rules)
    n = np.array([count.get(p, 0) for p in every], float)
    total = max(n.sum(), 1.0)
    right = np.array([[0.02, 0.20, 0.78], [0.50, 0.10, 0.40]])  # good, then bad: P(vote 0, 1, 2)
    p = np.repeat(right[:, None, :], n_rules, axis=1)
    share = prior
    hot = np.eye(3)[votes]
    good = np.full(len(every), prior)
    for _ in range(rounds):
        log = [np.log(w) + np.einsum("prv,rv->p", hot, np.log(p[c])) for c, w in ((0, share), (1, 1 - share))]
        new = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
        done, good = np.abs(new - good).max() < 1e-10, new
        if done:
            break
        for c, w in ((0, n * good), (1, n * (1 - good))):
            seen = np.einsum("p,prv->rv", w, hot) + strength * total * right[c]
            p[c] = seen / seen.sum(axis=1, keepdims=True)
        share = (n @ good + prior * strength * total) / (total * (1 + strength))
    return dict(zip(every, good.tolist(), strict=True))


def judged(docs: DataFrame, text: str = "text", threshold: float = 0.5, min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """Every row with its features, base_failed, posterior (of good) and kept.

    Votes are counted over all rows (one aggregation to at most 3**7 rows on the driver).
    """
    seen = with_features(docs.drop(*VERDICT), text)
    votes = rules()
    code = sum((v * 3**i for i, v in enumerate(votes.values())), F.lit(0)).cast("int")
    counted = with_features(docs.select(text), text).groupBy(code.alias("code")).count().collect()
    digits = lambda k: tuple(k // 3**i % 3 for i in range(len(votes)))
    posterior = fit([(digits(r["code"]), r["count"]) for r in counted], len(votes))
    by_code = [posterior[digits(k)] for k in range(3 ** len(votes))]
    return (
        seen.withColumn("base_failed", base_failed(min_words, repeat_percent))
        .withColumn("posterior", F.element_at(F.lit(np.array(by_code)), code + 1))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )


def filtered(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows that are kept, in their own columns, whatever their names."""
    inner, own = packed(docs, text)
    found = judged(inner.withColumnRenamed(text, "_text"), "_text", **options).filter("kept")
    return found.select(*(F.col("_text").alias(text) if c == text else x for c, x in zip(docs.columns, own)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE_SQL: dict[str, str] = {}
