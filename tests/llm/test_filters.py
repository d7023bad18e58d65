import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relaylens.llm import quality, repetition, toxicity
from relaylens.llm.queries import op4_quality_classifier, op7_quality_rules, op9_toxicity
from tests.conftest import SF01
from tests.llm.helpers import AWKWARD, table, write


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = sum(map(len, words))
    shares, n_repeat = {}, 0
    for n in repetition.NGRAM_LIMITS:
        runs = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        counts, seen, covered, either = Counter(runs), set(), set(), set()
        for i, r in enumerate(runs):
            if r in seen:
                covered |= set(range(i, i + n))
            seen.add(r)
            if counts[r] > 1:
                either |= set(range(i, i + n))
        shares[n] = sum(len(words[i]) for i in covered) / chars if chars else 0.0
        if n == 5:
            n_repeat = len(either)
    lines, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own and line in lines:
            dup += 1
            dup_chars += sum(map(len, own))
        lines.add(line)
    share = dup_chars / chars if chars else 0.0
    failed = len(words) < 10 or 100 * n_repeat > 20 * len(words)
    kept = not failed and share <= repetition.LINE_LIMIT and all(shares[n] <= v for n, v in repetition.NGRAM_LIMITS.items())
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, n_repeat, failed, kept, share, *shares.values())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "c#", "\n", "d\x1ce", "f\xa0g", "\x0b", "é|"]), max_size=60))
def test_rules_against_brute_force(parts):
    text = " ".join(parts)
    with np.errstate(over="ignore"):
        assert repetition.measure_text(text) == pytest.approx(brute_rules(text))


def test_rules_query_against_brute_force(spark):
    got = {r.doc_id: r for r in op7_quality_rules(spark, SF01).collect()}
    for key, text in duckdb.sql(f"select doc_id, text from '{SF01}/documents.parquet'").fetchall():
        assert tuple(got[key])[1:] == pytest.approx(brute_rules(text or "")), key


def test_rules_on_awkward_rows(spark):
    docs = table(spark, AWKWARD)
    rows = repetition.measure(docs).collect()
    assert len(rows) == len(AWKWARD) and {r.n_words for r in rows if r.doc_id in (2, 3, 4)} == {0}
    kept = repetition.keep(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted((r.doc_id or 0) for r in rows if r.kept)
    assert repetition.measure(docs.where("false")).count() == 0 == repetition.keep(docs.where("false")).count()


def test_ordinal_gradient_and_order():
    """The fit recovers ascending grades from one noisy direction, and its
    thresholds stay in order."""
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(600):
        g = int(rng.integers(0, 4))
        n = 2 + 4 * g + int(rng.integers(0, 3))
        rows.append((np.arange(20, dtype=np.int32), np.r_[np.ones(n), np.zeros(20 - n)].astype(np.float32)))
        grades.append(g)
    grades = np.array(grades)
    model = quality.fit(rows, grades, 4)
    assert (np.diff(model.thresholds) > 0).all()
    scores = np.array([model.weights[i] @ v for i, v in rows])
    guess = (scores[:, None] > model.thresholds).sum(axis=1)
    assert (guess == grades).mean() > 0.95


def test_quality_held_out_accuracy(spark):
    got = op4_quality_classifier(spark, SF01)
    assert got.count() == 1000
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    good = [r.kept for r in rows if r.quality == 1]
    poor = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(poor) < 0.4
    for r in rows:
        assert 1 >= r.p_at_least_1 >= r.p_at_least_2 >= 0
        assert r.expected_grade == pytest.approx(r.p_at_least_1 + r.p_at_least_2)


def test_quality_on_awkward_rows(spark, tmp_path):
    folder = write(spark, tmp_path, AWKWARD, [(1, 1, 0), (5, 0, 0), (None, 1, 0), (8, None, 0), (9, 1, 1), (9, 0, 0), (7, 1, None)])
    docs = table(spark, AWKWARD)
    model = quality.learn(docs, folder)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(AWKWARD)
    kept = quality.keep(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(r.kept for r in rows)
    empty = table(spark, [])
    assert quality.score(empty, quality.learn(empty, folder)).count() == 0
    nothing = quality.fit([], np.zeros(0, int), 3)
    assert nothing.tails("some text").tolist() == [0.5, 0.5]


def brute_segments(scores):
    """All maximal scoring subsequences by their definition: the best
    segment (shortest on ties), then the same left and right of it."""

    def go(a, b):
        best = None
        for i in range(a, b):
            s = 0.0
            for j in range(i, b):
                s += scores[j]
                if s > 0 and (best is None or s > best[2] + 1e-9 or abs(s - best[2]) <= 1e-9 and j + 1 - i < best[1] - best[0]):
                    best = (i, j + 1, s)
        return go(a, best[0]) + [best] + go(best[1], b) if best else []

    return go(0, len(scores))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(-50, 50), max_size=14))
def test_segments_against_brute_force(values):
    # distinct tiny offsets break ties between segments
    scores = np.array([v + (i + 1) * 1e-3 for i, v in enumerate(values)])
    got = [(a, b, pytest.approx(s)) for a, b, s in toxicity.segments(scores)]
    assert got == brute_segments(scores.tolist())


@pytest.mark.parametrize("pattern", [[1.0, -1.3], [1.0, -0.7], [5.0, -1.0, 0.5, -1.0, 0.5, -2.0]])
def test_segments_take_linear_time(pattern):
    """Drifting down, up, and candidates that hide one another."""

    def seconds(n):
        scores = np.resize(np.array(pattern), n)
        t = time.perf_counter()
        toxicity.segments(scores)
        return time.perf_counter() - t

    assert seconds(200_000) < 2.0


def test_lambda():
    scores, weights = np.array([-1.0, 1.0]), np.array([0.75, 0.25])
    assert toxicity.solve_lambda(scores, weights) == pytest.approx(np.log(3))


def scorer(words):
    return toxicity.Scorer(np.zeros((0, 2)), np.zeros(0), cache=dict(words))


VILE = {f"t{i}": 2.0 for i in range(10)}


@pytest.mark.parametrize("between", [15, 200])
def test_equal_passages_of_a_long_text_all_count(between):
    model = scorer({**VILE, "c": -0.6})
    text = " ".join((["c"] * between + list(VILE)) * 3 + ["c"] * between)
    scores = model.without_repeats(text.split())
    assert (scores > 0).sum() == 30
    rated = [r for r in model.evidence(text)[3] if r[3] < toxicity.E_LIMIT]
    if between == 200:
        assert [(b - a, s) for a, b, s, _ in rated] == [(10, 20.0)] * 3
    else:
        assert [s for _, _, s, _ in rated] == [pytest.approx(60 - 30 * 0.6)]


def test_a_passage_counts_after_its_words_were_used_alone():
    model = scorer({**VILE, "c": -0.6})
    alone = " ".join(" ".join([w] + ["c"] * 10) for w in [*VILE, *VILE])
    passage = " ".join(VILE)
    found = model.evidence(f"{alone} {passage}")[3]
    assert max(s for _, _, s, _ in found) == 20.0


def test_stuttered_words_do_not_add_up():
    model = scorer({"a": 0.5, "b": 0.4, "c": -0.6})
    for text in ("a " * 400, "a b " * 200, "a a b c " * 100):
        assert max(s for _, _, s, _ in model.evidence(text)[3]) <= 1.8 + 1e-9


def test_toxicity_held_out_accuracy(spark):
    got = op9_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(toxic) > 0.75 and np.mean(clean) < 0.02
    assert all((r.score >= 0.5) == bool(r.predicted) and 0 <= r.score <= 1 for r in rows)
    assert all(p.end > p.start and p.e_value < toxicity.E_LIMIT for r in rows for p in r.passages)


def test_toxicity_on_awkward_rows(spark, tmp_path):
    rows = AWKWARD + [(100 + i, f"plain words number {i} here" if i % 2 else f"vile insult number {i} here") for i in range(60)]
    labels = [(100 + i, 1, int(i % 2 == 0)) for i in range(60)] + [(None, 1, 1), (8, 1, None)]
    folder = write(spark, tmp_path, rows, labels)
    docs = table(spark, rows)
    got = toxicity.score(docs, toxicity.learn(docs, folder))
    assert got.count() == len(rows)
    empty = table(spark, [])
    assert toxicity.score(empty, toxicity.learn(empty, folder)).count() == 0
    # no labels: flat, nothing predicted
    bare = write(spark, tmp_path / "bare", rows)
    flat = toxicity.score(docs, toxicity.learn(docs, bare)).agg(F.max("predicted"), F.countDistinct("score")).first()
    assert tuple(flat) == (0, 1)
