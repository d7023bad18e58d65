"""Toxicity by maximum-scoring segments.

* **Log-odds.**  Each word's score is its log-odds between toxic and clean
  documents, under Dirichlet priors in two levels: a word's prior is what
  its first ``PREFIX`` letters say, and the prefix's prior is the share of
  toxic documents.  Counts are numbers of documents per hashed word and
  prefix (``DIMS`` buckets each, the bound of the model's size).  ``GAP`` is
  taken off every word, so clean text drifts down.
* **Segments.**  One pass over a text (runs of like sign, then the stack
  algorithm for all maximal scoring subsequences) finds every passage whose
  score cannot be raised by lengthening or shortening it.
* **Extreme values.**  A passage of score S in a text of n words has
  E = K n exp(-lambda S) expected equals in clean text: lambda solves
  sum p(w) exp(lambda s(w)) = 1 over clean text, K is the maximum-likelihood
  value from clean documents.  A passage is significant below ``E_LIMIT``.
* **Score.**  The surprise -ln E of the best passage and the sum over all
  significant ones go through a logistic curve fitted on labelled documents
  that gave no counts.

Labels are learned only outside the held-out fifth, from at most
``FIT_ROWS`` documents.  Texts without words (null, empty) get the curve's
value at no surprise.  Repeated rows are scored each; other columns are not
read; without labels, or labels of one kind, the curve is flat at the share
of toxic ones (0 if none).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylens.llm.caches import claim
from relaylens.llm.labelled import held_out, labelled_sample
from relaylens.llm.ship import ship, small, to_table, whole_text

DIMS = 1 << 18
PREFIX = 5
#: The bound of the fitting sample (documents); a third of it, by id, sets
#: the extreme-value constants and the curve, the rest the counts.
FIT_ROWS = 20_000
GAP = 0.3
PRIOR_WORD, PRIOR_PREFIX = 8.0, 8.0
E_LIMIT = 0.05
#: How often one word adds evidence in a candidate passage; further ones count
#: as the gap, so a stuttered word of slight odds does not add up to a passage.
REPEATS = 2
#: A candidate passage is over when its running score has fallen by this much.
DROP = 6.0
CACHE_WORDS = 250_000
_EDGE = re.compile(r"^\W+|\W+$")


def keys_of(word: str) -> tuple[int, int]:
    """Buckets of a word (lower case, outer punctuation off) and of its
    prefix (the whole word if it is no longer)."""
    w = _EDGE.sub("", word.lower())
    return zlib.crc32(w.encode()) & (DIMS - 1), zlib.crc32(b"p " + w[:PREFIX].encode()) & (DIMS - 1)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time.

    Words are first merged into runs of one sign; a stack then keeps, per
    candidate, the running totals at its ends, and joins candidates while
    the later one's right total is the higher and the earlier one's left
    total the lower.  Each candidate knows the nearest one before it that
    begins from a lower total, so a search jumps over the others."""
    positive = scores > 0
    if not positive.any():
        return []
    edges = np.flatnonzero(np.diff(positive)) + 1
    starts = np.concatenate([[0], edges])
    ends = np.concatenate([edges, [len(scores)]])
    sums = np.add.reduceat(scores, starts)
    total = 0.0
    stack: list[tuple[int, int, float, float, int]] = []
    for a, b, s in zip(starts.tolist(), ends.tolist(), sums.tolist()):
        left, total = total, total + s
        if s <= 0:
            continue
        start, right = a, total
        while True:
            # the nearest candidate that begins from a lower total
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= right:
                break
            start, left = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((start, b, left, right, k))
    return [(a, b, r - l) for a, b, l, r, _ in stack]


@dataclass
class Scorer:
    """Word scores, extreme-value constants and the curve."""

    word: np.ndarray
    prefix: np.ndarray
    base: float = 0.0
    lam: float = 1.0
    k: float = 0.1
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    cache: dict[str, float] = field(default_factory=dict)

    def scores(self, words: list[str]) -> np.ndarray:
        got = list(map(self.cache.get, words))
        for i, v in enumerate(got):
            if v is None:
                a, b = keys_of(words[i])
                got[i] = v = self.one(a, b)
                if len(self.cache) < CACHE_WORDS:
                    self.cache[words[i]] = v
        return np.array(got, np.float64)

    def one(self, word: int, prefix: int) -> float:
        """Log-odds of a word less the gap: counts against the prior of its
        prefix, relative to the share of toxic documents."""
        share = self.prefix[prefix]
        toxic, clean = self.word[word]
        p = (toxic + PRIOR_WORD * share) / (toxic + clean + PRIOR_WORD)
        return float(np.log(p / (1 - p)) - self.base) - GAP

    def without_repeats(self, words: list[str], drop: float = DROP) -> np.ndarray:
        """Scores in which a word of positive score counts ``REPEATS`` times
        in a candidate passage.  A candidate is over, and all words count
        afresh, when its running score is back at zero or has fallen by
        ``drop``.  The constants, the curve and the verdict all use these
        scores."""
        scores, seen = self.scores(words), {}
        up = np.flatnonzero(scores > 0)
        fallen = np.cumsum(np.minimum(scores, 0.0))[up]
        running = peak = last = 0.0
        for i, f, s in zip(up.tolist(), fallen.tolist(), scores[up].tolist()):
            running, last = running + f - last, f
            if running <= 0 or peak - running >= drop:
                running, peak, seen = 0.0, 0.0, {}
            seen[words[i]] = seen.get(words[i], 0) + 1
            if seen[words[i]] > REPEATS:
                scores[i] = -GAP
                running -= GAP
            else:
                running += s
                peak = max(peak, running)
        return scores

    def evidence(self, text: str) -> tuple[float, float, int, list[tuple[int, int, float, float]]]:
        """Best and total surprise of significant passages, words, and all
        passages as (start, end, score, E)."""
        words = text.split()
        found = segments(self.without_repeats(words)) if words else []
        rated = [(a, b, s, self.k * len(words) * float(np.exp(-self.lam * s))) for a, b, s in found]
        surprise = [-np.log(max(e, 1e-300)) for *_, e in rated if e < E_LIMIT]
        return max(surprise, default=0.0), float(sum(surprise)), len(words), rated

    def probability(self, best: float, total: float) -> float:
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(best) + c * np.log1p(total), -500, 500))))


def count(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Documents per (bucket, class) for words and prefixes, and per class.

    Tasks count into fixed arrays, then one sum per bucket: what reaches the
    driver is bounded by ``DIMS``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        table = np.zeros((2, DIMS, 2), np.int64)
        docs = [0, 0]
        for batch in small(batches):
            for text, grade in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                side = 0 if grade else 1
                docs[side] += 1
                pairs = {keys_of(w) for w in set(text.split())}
                if pairs:
                    both = np.array(list(pairs), np.int64)
                    table[0, np.unique(both[:, 0]), side] += 1
                    table[1, np.unique(both[:, 1]), side] += 1
        kind, bucket = np.nonzero(table.sum(axis=2))
        n = table[kind, bucket]
        yield pa.RecordBatch.from_arrays(
            [pa.array([2, *kind.tolist()], pa.int32()), pa.array([0, *bucket.tolist()], pa.int32())]
            + [pa.array([docs[j], *n[:, j].tolist()], pa.int64()) for j in range(2)],
            names=["kind", "bucket", "toxic", "clean"],
        )

    rows = sample.select("text", "grade").mapInArrow(task, "kind int, bucket int, toxic long, clean long")
    got = rows.groupBy("kind", "bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    kind, bucket, n = got["kind"].to_numpy(), got["bucket"].to_numpy(), np.stack([got["toxic"].to_numpy(), got["clean"].to_numpy()], axis=1)
    out = np.zeros((2, DIMS, 2))
    for j in range(2):
        out[j, bucket[kind == j]] = n[kind == j]
    docs = n[kind == 2].sum(axis=0)
    return out[0], out[1], int(docs[0]), int(docs[1])


def solve_lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 (bisection)."""
    p = weights / weights.sum()
    if (scores * p).sum() >= 0 or scores.max() <= 0:
        return 1.0
    low, high = 1e-6, 1.0
    value = lambda x: float((p * np.exp(np.clip(x * scores, -700, 700))).sum()) - 1
    while value(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return (low + high) / 2


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of two surprises by Newton steps (ridge 1e-3)."""
    z = np.column_stack([np.ones(len(y)), np.log1p(x)])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + 1e-3 * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, sf_dir: str, fit_rows: int = FIT_ROWS) -> Scorer:
    """Counts from two thirds of the bounded sample, constants and curve
    from the last third."""
    ship(docs.sparkSession)
    grade = F.when(F.col("toxic").isNotNull(), (F.col("toxic") > 0).cast("int"))
    sample = to_table(labelled_sample(docs, sf_dir, grade, fit_rows).select("doc_id", "text", "grade"), "toxic-sample")
    third = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) == 0
    word, prefix, n_toxic, n_clean = count(sample.where(~third))
    share = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    prior = (prefix[:, 0] + PRIOR_PREFIX * share) / (prefix.sum(axis=1) + PRIOR_PREFIX)
    model = Scorer(word, prior, float(np.log(share / (1 - share))))

    def background(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A histogram of word scores in clean documents (in steps of 1/64)."""
        bins = np.zeros(4096, np.int64)
        for batch in small(batches):
            for text in batch.column(0).to_pylist():
                s = model.without_repeats(text.split())
                bins += np.bincount(np.clip(np.rint(s * 64).astype(np.int64) + 2048, 0, 4095), minlength=4096)
        used = np.flatnonzero(bins)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(bins[used])], names=["bin", "n"])

    clean = sample.where(third & (F.col("grade") == 0)).select("text")
    hist = clean.mapInArrow(background, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    if hist.num_rows:
        model.lam = solve_lambda((hist["bin"].to_numpy() - 2048) / 64, hist["n"].to_numpy().astype(float))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for text in batch.column(0).to_pylist():
                rated = model.evidence(text)
                rows.append((max((s for _, _, s, _ in rated[3]), default=0.0), rated[2], [s for _, _, s, _ in rated[3]]))
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.float64()))],
                names=["grade", "best", "n", "scores"],
            )

    rest = sample.where(third).select("text", "grade").mapInArrow(tops, "grade int, best double, n long, scores array<double>").toArrow()
    y, best, n = rest["grade"].to_numpy().astype(float), rest["best"].to_numpy(), rest["n"].to_numpy()
    if not len(y) or y.min() == y.max():
        total = n_toxic + n_clean + len(y)
        odds = (n_toxic + float(y.sum())) / total if total else 0.0
        model.curve = (float(np.log(max(odds, 1e-9) / max(1 - odds, 1e-9))), 0.0, 0.0)
        return model
    calm = y == 0
    model.k = float(max(1, calm.sum()) / max(1e-9, (n[calm] * np.exp(-model.lam * best[calm])).sum()))
    surprises = []
    for m, found in zip(n, rest["scores"].to_pylist()):
        e = model.k * m * np.exp(-model.lam * np.array(found, float))
        s = -np.log(np.maximum(e[e < E_LIMIT], 1e-300))
        surprises.append((s.max() if len(s) else 0.0, s.sum()))
    model.curve = fit_curve(np.array(surprises), y)
    return model


def score(docs: DataFrame, model: Scorer) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_words, passages
    (significant ones: first word, word after the last, score, E)."""
    ship(docs.sparkSession)
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_words", pa.int64()), ("passages", pa.list_(passage))]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for batch in small(batches):
            cols: list[list] = [[] for _ in range(4)]
            for text in batch.column(2).to_pylist():
                best, total, n, rated = model.evidence(text)
                p = model.probability(best, total)
                found = [dict(zip(("start", "end", "score", "e_value"), r)) for r in rated if r[3] < E_LIMIT]
                for c, v in zip(cols, (p, int(p >= 0.5), n, found)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, schema.types[2:]))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), whole_text().alias("text"))
    return rows.mapInArrow(
        task, "doc_id long, held_out boolean, score double, predicted int, n_words long, passages array<struct<start:long,end:long,score:double,e_value:double>>"
    )
