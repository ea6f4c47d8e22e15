"""Document quality from a linear-chain conditional random field over lines.

Each line that holds a word gets features of its own text and of its neighbours' lines; the
chain ties neighbouring labels. Training takes every line of a labelled document to bear the
document's label. Forward-backward gives each line's probability of being good; their mean,
weighted by line length, is calibrated to the document's score by a logistic curve fitted on
the same training rows.

The model is fitted on at most `sample` labelled documents, those with the least hash of the id;
everything else (scoring) covers all documents and whole texts, without a shuffle. Rows whose
crc32(id as text) is divisible by 5 are held out of the fit. Labels, lang, source and ids are no
inputs of a score.

Defined results: a null, empty or word-free text scores 0; without usable labels, or with labels of
one class only, lines are weighed by no feature and texts score 0.5; a document with several labels
takes the least; null labels are left out. Other columns pass through; new columns replace input
columns so named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import _text as t
from fieldloom.llm._tables import table

SAMPLE = 2000
FOLDS = 5
THRESHOLD = 0.3
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&<>")] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".,;:")] = True
OWN = ("bias", "symbols", "bars", "upper", "bangs", "digits", "stops", "other_bytes", "repeats", "same_as_before", "word_length", "long", "short")


def held_out(id: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(id).cast("string"), F.lit("")), "UTF-8")) % FOLDS == 0


def line_features(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (own, previous and next line's), offsets of the texts in the sequence of lines, line lengths in bytes."""
    start, end, word_at = t.words(buf, at)
    begin, stop = t.runs(buf != 10, at)
    first, last = np.searchsorted(start, begin, "left"), np.searchsorted(start, stop, "left")
    spoken = last > first
    begin, stop, first, last = begin[spoken], stop[spoken], first[spoken], last[spoken]
    line_at = np.searchsorted(begin, at, "left")
    size, words = (stop - begin).astype(float), (last - first).astype(float)

    def share(marks: np.ndarray, whole: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks)])
        return (total[stop] - total[begin]) / np.maximum(whole, 1)

    hashed = t.byte_hasher(buf)
    word = hashed(start, end)
    same = np.concatenate([[0, 0], np.cumsum(word[1:] == word[:-1])]) if len(word) else np.zeros(1)
    line = hashed(begin, stop)
    again = np.zeros(len(line))
    again[1:] = line[1:] == line[:-1]
    upper = (buf >= 65) & (buf <= 90)
    letters = upper | ((buf >= 97) & (buf <= 122))
    n_letters = share(letters, np.ones(len(begin)))
    own = np.stack(
        [
            np.ones(len(begin)),
            np.minimum(3 * share(_SYMBOLS[buf], words), 3),
            np.minimum(4 * share(buf == 124, words), 3),
            3 * share(upper, n_letters) * (n_letters >= 4),
            np.minimum(2 * share(buf == 33, words), 3),
            2 * share((buf >= 48) & (buf <= 57), size),
            np.minimum(share(_STOPS[buf], words), 2),
            share(buf >= 128, size),
            3 * (same[last] - same[np.minimum(first + 1, last)]) / words,
            again,
            np.minimum(share(t.NOT_SPACE[buf], words) / 8, 3),
            np.log1p(words) / 4,
            words < 3,
        ],
        axis=1,
    ).astype(np.float32)
    n = len(own)
    inner = np.ones((n, 1), np.float32)
    if n:
        inner[line_at[:-1][line_at[:-1] < n]] = 0
    before = np.concatenate([own[:1], own[:-1]]) * inner
    outer = np.concatenate([inner[1:], np.zeros((min(n, 1), 1), np.float32)])
    after = np.concatenate([own[1:], own[-1:]]) * outer
    return np.concatenate([own, before, after], axis=1), line_at, size


class Crf:
    """Two labels (0 bad, 1 good); weights of the features for label 1, and of pairs of labels."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.pairs, self.slope, self.shift = weights, pairs, slope, shift

    def marginals(self, features: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of label 1 of each line, and the expected number of each pair of neighbouring labels.

        All texts advance together, longest first, one line a step.
        """
        odds = np.clip(features @ self.weights, -30, 30)
        psi = np.stack([1 / (1 + np.exp(odds)), 1 / (1 + np.exp(-odds))], axis=1)
        move = np.exp(self.pairs)
        size = np.diff(at)
        order = np.argsort(-size, kind="stable")
        begin, size = at[:-1][order], size[order]
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
        alpha, beta = np.empty_like(psi), np.ones_like(psi)
        for step, n in enumerate(active.tolist()):
            row = begin[:n] + step
            got = psi[row] if step == 0 else (alpha[row - 1] @ move) * psi[row]
            alpha[row] = got / got.sum(axis=1, keepdims=True)
        expected = np.zeros((2, 2))
        for step in range(len(active) - 1, 0, -1):
            row = begin[: active[step]] + step
            push = psi[row] * beta[row]
            back = push @ move.T
            total = (alpha[row - 1] * back).sum(axis=1)
            expected += move * (alpha[row - 1].T @ (push / total[:, None]))
            beta[row - 1] = back / back.sum(axis=1, keepdims=True)
        both = alpha * beta
        return both[:, 1] / both.sum(axis=1), expected

    def means(self, features: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Length-weighted mean probability of good lines; nan for a text without lines."""
        good, _ = self.marginals(features, at)
        sums = lambda v: np.diff(np.concatenate([[0.0], np.cumsum(v)])[at])
        with np.errstate(invalid="ignore", divide="ignore"):
            return sums(good * size) / sums(size)

    def scores(self, features: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        mean = self.means(features, at, size)
        return np.where(np.isnan(mean), 0.0, 1 / (1 + np.exp(-np.clip(self.slope * mean + self.shift, -500, 500))))


def fit(features: np.ndarray, at: np.ndarray, size: np.ndarray, label: np.ndarray, rounds: int = 80, decay: float = 1e-3) -> Crf:
    """Maximum likelihood by Adam, then the calibration by Newton steps."""
    width = features.shape[1]
    if len(set(label.tolist())) < 2:
        return Crf(np.zeros(width), np.zeros((2, 2)), 0.0, 0.0)
    lines = np.repeat(label, np.diff(at)).astype(float)
    inner = np.ones(len(lines), bool)
    inner[at[:-1][at[:-1] < len(lines)]] = False
    seen = np.bincount((lines[:-1] * 2 + lines[1:]).astype(int)[inner[1:]], minlength=4).reshape(2, 2)
    n = max(len(lines), 1)
    theta, first, second = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for i in range(1, rounds + 1):
        good, expected = Crf(theta[:width], theta[width:].reshape(2, 2)).marginals(features, at)
        slope = np.concatenate([features.T @ (lines - good), (seen - expected).ravel()]) / n - decay * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta + 0.2 * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)
    model = Crf(theta[:width], theta[width:].reshape(2, 2))
    mean = model.means(features, at, size)
    some = ~np.isnan(mean)
    x, y, w = np.stack([mean[some], np.ones(some.sum())], axis=1), label[some].astype(float), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w + np.linalg.solve(hess, x.T @ (y - p) - 1e-2 * w)
    model.slope, model.shift = float(w[0]), float(w[1])
    return model


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Crf:
    """Fits the model on at most `sample` labelled documents that are not held out; the driver gets their lines' features."""
    chosen = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull() & ~held_out(id)).groupBy(id).agg(F.min(label).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64(id), id).limit(sample)
    rows = docs.select(id, text).join(F.broadcast(chosen), id).select(text, "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in t.slices(batches, text):
            found, at, size = line_features(*t.utf8(t.column(batch, text)))
            cut = [(a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            arrays = [pa.array([found[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([size[a:b].tobytes() for a, b in cut], pa.binary()), t.column(batch, "_label")]
            yield pa.RecordBatch.from_arrays(arrays, names=["f", "s", "y"])

    got = rows.mapInArrow(run, "f binary, s binary, y int").collect()
    got.sort(key=lambda r: (r["y"], bytes(r["s"]), bytes(r["f"])))
    width = 3 * len(OWN)
    features = np.concatenate([np.zeros((0, width), np.float32), *(np.frombuffer(r["f"], np.float32).reshape(-1, width) for r in got)])
    sizes = [np.frombuffer(r["s"], float) for r in got]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sizes])]).astype(np.int64)
    return fit(features, at, np.concatenate([np.zeros(0), *sizes]), np.array([r["y"] for r in got], int))


def scored(docs: DataFrame, model: Crf, text: str = "text", name: str = "score") -> DataFrame:
    """Every row with its score; no shuffle."""
    docs = docs.drop(name)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in t.slices(batches, text):
            got = model.scores(*line_features(*t.utf8(t.column(batch, text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*names, name])

    return docs.mapInArrow(run, t.arrow_type(docs, f"{name} double"))


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op7_line_crf": op7_line_crf}
ORACLE_SQL: dict[str, str] = {}
