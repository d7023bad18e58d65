"""Quality classifier: ordinal cumulative-link regression.

Ratings are grades 0..K-1.  One weight vector over hashed text features is
shared by all grades; ascending thresholds cut its score::

    P(grade <= k | text) = sigmoid(threshold[k] - weights . features)

which gives the expected grade and the tail probability P(grade >= k) used
for selection.  Features (unit length, hashed to ``DIMS``): the text's words
without punctuation, each word's shape (case, digits, the punctuation it
carries) with how often it occurs, and binned statistics of the whole text
(share of distinct words, most frequent word, immediate repeats, upper case,
symbols, repeated lines, length).

The model is fitted on at most ``FIT_ROWS`` labelled documents; a held-out
fifth is never learned from.  Scoring is row-local over whole texts.  A null
or empty text has the empty text's features.  Repeated rows are scored each;
``keep`` returns kept rows with all their columns untouched.  Without labels
there is nothing to learn: every document is kept with even odds.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens.llm.caches import claim, register
from relaylens.llm.labelled import held_out, labelled_sample
from relaylens.llm.ship import ship, small, whole_text

DIMS = 1 << 16
#: The bound of the fitting sample (documents).
FIT_ROWS = 6_000
STEPS = 120
RATE = 0.3
L2 = 1e-5
CACHE_WORDS = 250_000
SYMBOLS = "#*$%&|<>{}[]=_\\^~"

_FEATURES: dict[str, int] = {}
register("quality", _FEATURES.clear)
_CORE = re.compile(r"\w+")


def bucket(name: str) -> int:
    return zlib.crc32(name.encode()) & (DIMS - 1)


def word_features(word: str) -> int:
    """Buckets of the word itself and of its shape, in one number."""
    core = "".join(_CORE.findall(word))
    case = "U" if len(core) > 1 and core.isupper() else "t" if core[:1].isupper() else "l" if core else ""
    shape = case + _CORE.sub("w", word)[:12] + ("0" if any(c.isdigit() for c in core) else "")
    return bucket("w " + core.lower()) * DIMS + bucket("s " + shape)


def statistics(text: str, words: list[str], counts: Counter) -> list[str]:
    """Names of the bins that the text's overall figures fall in."""

    def bins(name: str, value: float, steps: int = 20) -> str:
        return f"{name} {int(value * steps)}"

    total = len(words)
    if not total:
        return ["no words"]
    stuttered = sum(map(operator.eq, words, words[1:]))
    lines = text.split("\n")
    upper = sum(n for w, n in counts.items() if len(w) > 1 and w.isupper())
    return [
        bins("distinct", len(counts) / total, 10) + f" {total.bit_length()}",
        bins("top", max(counts.values()) / total),
        bins("stutter", stuttered / total),
        bins("upper", upper / total),
        bins("symbols", min(1.0, sum(map(text.count, SYMBOLS)) / total)),
        bins("digits", min(1.0, sum(map(text.count, "0123456789")) / len(text))),
        bins("marks", min(1.0, sum(map(text.count, "!?")) / total)),
        bins("lines", 1 - len(set(lines)) / len(lines), 10),
        bins("length", len(text) / total / 10, 10),
        f"words {total.bit_length()}",
    ]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of one whole text: words share one unit of
    length, shapes one, statistics one."""
    words = text.split()
    counts = Counter(words)
    pairs = []
    for w in counts:
        got = _FEATURES.get(w)
        if got is None:
            got = word_features(w)
            if len(_FEATURES) < CACHE_WORDS:
                _FEATURES[w] = got
        pairs.append(got)
    n = np.fromiter(counts.values(), np.float64, len(counts))
    names = [bucket(x) for x in statistics(text, words, counts)]
    if not pairs:
        return np.array(names, np.int32), np.ones(len(names), np.float32)
    both = np.array(pairs, np.int64)
    kinds, which = np.unique(both % DIMS, return_inverse=True)
    word, shape = np.log1p(n), np.bincount(which, weights=n)
    shape = np.sqrt(shape / shape.sum())
    index = np.concatenate([both // DIMS, kinds, names])
    value = np.concatenate([word / np.linalg.norm(word), shape, np.full(len(names), len(names) ** -0.5)])
    return index.astype(np.int32), value.astype(np.float32)


@dataclass
class Ordinal:
    """A fitted model: shared weights, ascending thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str) -> np.ndarray:
        """P(grade >= k) for k = 1..K-1."""
        index, value = features(text)
        score = float(self.weights[index] @ value)
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - score, -500, 500)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, steps: int = STEPS) -> Ordinal:
    """Maximum likelihood by full-batch Adam; thresholds are a first cut and
    log gaps, so they stay in order.  Works on any number of rows."""
    if not rows:
        return Ordinal(np.zeros(DIMS), np.zeros(n_grades - 1))
    index = np.concatenate([i for i, _ in rows])
    value = np.concatenate([v for _, v in rows]).astype(np.float64)
    sizes = np.array([len(i) for i, _ in rows])
    starts = np.cumsum(sizes) - sizes
    used, index = np.unique(index, return_inverse=True)
    share = np.clip([(grades <= k).mean() for k in range(n_grades - 1)], 0.01, 0.99)
    cuts = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(len(used)), cuts[:1], np.log(np.maximum(np.diff(cuts), 0.05))])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    low_open, high_open = grades == 0, grades == n_grades - 1
    for step in range(1, steps + 1):
        w = theta[: len(used)]
        gaps = np.exp(theta[len(used) + 1 :])
        cut = theta[len(used)] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.add.reduceat(w[index] * value, starts)
        upper = np.where(high_open, 1.0, sigmoid(cut[np.minimum(grades, n_grades - 2)] - score))
        lower = np.where(low_open, 0.0, sigmoid(cut[np.maximum(grades - 1, 0)] - score))
        p = np.maximum(upper - lower, 1e-12)
        d_up, d_low = upper * (1 - upper) / p, lower * (1 - lower) / p
        d_score = (d_up - d_low) / len(rows)
        grad_w = np.bincount(index, weights=value * np.repeat(d_score, sizes), minlength=len(used)) + L2 * w
        d_cut = np.zeros(n_grades - 1)
        np.add.at(d_cut, np.minimum(grades, n_grades - 2)[~high_open], -d_up[~high_open] / len(rows))
        np.add.at(d_cut, np.maximum(grades - 1, 0)[~low_open], d_low[~low_open] / len(rows))
        tail = np.cumsum(d_cut[::-1])[::-1]
        grad = np.concatenate([grad_w, tail[:1], tail[1:] * gaps])
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        theta = theta - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    weights = np.zeros(DIMS)
    weights[used] = theta[: len(used)]
    cut = theta[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(theta[len(used) + 1 :]))])
    return Ordinal(weights, cut)


def label_grade() -> Column:
    """Grades from the labels: 0 poor, 1 good but toxic, 2 good."""
    poor, toxic = F.col("quality") < 1, F.coalesce(F.col("toxic"), F.lit(0)) > 0
    return F.when(F.col("quality").isNull(), None).when(poor, 0).when(toxic, 1).otherwise(2)


def learn(docs: DataFrame, sf_dir: str, grade: Column | None = None, n_grades: int = 3, fit_rows: int = FIT_ROWS) -> Ordinal:
    """Fit on the bounded labelled sample.  Features are computed in tasks;
    the driver receives at most ``fit_rows`` hashed vectors."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, sf_dir, label_grade() if grade is None else grade, fit_rows)
    schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("index", pa.binary()), ("value", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in small(batches):
            rows = [features(t) for t in batch.column(1).to_pylist()]
            cols = [batch.column(0), batch.column(2), pa.array([i.tobytes() for i, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    table = sample.select("doc_id", "text", "grade").mapInArrow(task, "doc_id long, grade int, index binary, value binary").toArrow()
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    index, value = table["index"].to_pylist(), table["value"].to_pylist()
    rows = [(np.frombuffer(index[i], np.int32), np.frombuffer(value[i], np.float32)) for i in order]
    return fit(rows, table["grade"].to_numpy()[order].astype(np.int64), n_grades)


def score(docs: DataFrame, model: Ordinal, threshold: float = 0.5, at_least: int = 1) -> DataFrame:
    """doc_id, held_out, expected_grade, p_at_least_k per k, kept: the tail
    probability P(grade >= ``at_least``) reaches ``threshold``."""
    ship(docs.sparkSession)
    n = len(model.thresholds)
    names = [f"p_at_least_{k}" for k in range(1, n + 1)]
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("expected_grade", pa.float64()), *((x, pa.float64()) for x in names), ("kept", pa.bool_())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in small(batches):
            tails = np.array([model.tails(t) for t in batch.column(2).to_pylist()]).reshape(-1, n)
            cols = [batch.column(0), batch.column(1), pa.array(tails.sum(axis=1)), *(pa.array(tails[:, k]) for k in range(n))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(tails[:, at_least - 1] >= threshold)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), whole_text().alias("text"))
    kinds = ", ".join(f"{x} double" for x in names)
    return rows.mapInArrow(task, f"doc_id long, held_out boolean, expected_grade double, {kinds}, kept boolean")


def keep(docs: DataFrame, model: Ordinal, threshold: float = 0.5, at_least: int = 1) -> DataFrame:
    """The rows whose tail probability reaches ``threshold``."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in small(batches):
            good = [model.tails(t or "")[at_least - 1] >= threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
