import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from relaylens.llm import phrases
from relaylens.llm.mining_sql import collocations_sql
from relaylens.llm.queries import op11_phrase_mining
from tests.llm.helpers import AWKWARD, table, write


def brute(rows, least):
    """Everything by the definitions, on Python dictionaries."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = re.findall("[^ \t]+", piece)
            total[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inner = {}
    for (lang, ws), a in cand.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                key = (lang, ws[i : i + k])
                inner[key] = max(inner.get(key, 0), a)
    out = []
    for (lang, ws), a in cand.items():
        if 100 * inner.get((lang, ws), 0) >= 100 * a:
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]], total[lang]))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(out):
        seen[lang] += 1
        ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, n, -score))
    return ranked


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def corpus(seed, n=300):
    r = random.Random(seed)
    words = ["la", "Le", "piña", "x", "B-2", "café", "o'k", "日本", "zz", "q r"]
    fixed = ["New York City hall", "to be or not to", "Été LE piña x"]
    rows = []
    for _ in range(n):
        parts = [r.choice(fixed) if r.random() < 0.4 else " ".join(r.choices(words, k=r.randint(0, 9))) for _ in range(r.randint(0, 6))]
        rows.append((r.choice(["en", "fr", None, "und", ""]), r.choice([". ", ", ", "\n", " \t "]).join(parts)))
    return rows


@pytest.mark.parametrize("seed, least", [(1, 3), (2, 12), (3, 40)])
def test_against_brute_force(spark, seed, least):
    rows = corpus(seed)
    got = phrases.collocations(docs_of(spark, rows), least)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, least))


def test_small_blocks_parts_and_filter(spark, monkeypatch):
    """Many blocks and partitions, summaries that overflow: same result."""
    monkeypatch.setattr(phrases, "BLOCK_CHARS", 300)
    monkeypatch.setattr(phrases, "PART_MASS", 200)
    monkeypatch.setattr(phrases, "PENDING", 20)
    rows = corpus(5)
    got = phrases.collocations(docs_of(spark, rows).repartition(5), 25)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 25))


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """More survivors than the filter tells apart: more is shipped, the same
    comes out."""
    rows = corpus(6)
    want = sorted(brute(rows, 10))
    monkeypatch.setattr(phrases, "survivors", lambda docs, least: (b"\xff" * (phrases.FILTER_BITS // 8), 8))
    assert sorted(map(tuple, phrases.collocations(docs_of(spark, rows), 10).collect())) == want


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 30)), min_size=1, max_size=400), st.integers(2, 50), st.randoms())
@settings(max_examples=60, deadline=None)
def test_summaries_never_lose_a_frequent_key(entries, least, rnd):
    """Any order of merges; every key that counts ``least`` survives and
    counters are short of the truth by the error at most."""
    truth = Counter()
    for k, c in entries:
        truth[k] += c
    s = phrases.MisraGries(sum(truth.values()) // least + 1)
    rnd.shuffle(entries)
    while entries:
        cut = rnd.randint(1, len(entries))
        part, entries = entries[:cut], entries[cut:]
        s.merge(np.array([k for k, _ in part], np.uint32), np.array([c for _, c in part], np.int64))
        assert len(s.keys) <= s.capacity
    assert s.error < least
    assert {k for k, c in truth.items() if c >= least} <= set(s.at_least(least).tolist())
    for k, c in zip(s.keys.tolist(), s.counts.tolist()):
        assert truth[k] - s.error <= c <= truth[k]


def test_only_frequent_runs_are_counted_in_the_second_pass(spark):
    rows = [("en", f"alpha beta gamma{i} delta{i} beta{i}") for i in range(500)]
    bits, parts = phrases.survivors(docs_of(spark, rows), 100)
    words = phrases.Words("en", [rows[7][1]])
    counted = {(n, p) for n, p, _ in words.count(np.frombuffer(bits, np.uint8), parts)}
    assert {(1, "alpha"), (1, "beta"), (2, "alpha beta")} <= counted and len(counted) < 6


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_CHARS", 50)
    text = ", ".join(f"one two three{i}" for i in range(100))
    parts = list(phrases.slices(text))
    assert len(parts) > 20 and "".join(parts).replace(",", "") == text.replace(",", "")
    assert list(phrases.slices("a" * 500)) == ["a" * 500]


def test_scores_past_64_bits(spark, monkeypatch):
    """1000 * a * n of a huge corpus, from counts put in its place."""
    big = 3_000_000_000_000
    counts = [("en", 0, "", 50 * big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 2)]
    monkeypatch.setattr(phrases, "count_runs", lambda docs, least: spark.createDataFrame(counts, phrases.COUNTED))
    got = phrases.collocations(docs_of(spark, [])).collect()
    assert [(r.score, r.a) for r in got] == [(1000 * (big - 2) * 50 * big // (big * (big - 1)), big - 2)]


def test_query_on_awkward_rows_and_empty_tables(spark, tmp_path):
    rows = [(i, t) for i, t in AWKWARD if len(t or "") < 1000] * 120
    d = write(spark, tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    want = con.execute(collocations_sql()).fetchall()
    assert sorted(map(tuple, op11_phrase_mining(spark, d).collect())) == sorted(want) and want
    assert phrases.collocations(table(spark, AWKWARD[1:4])).count() == 0
    texts = [("und", t) for _, t in AWKWARD]  # with a text of 40,000 words
    assert sorted(map(tuple, phrases.collocations(docs_of(spark, texts), 15).collect())) == sorted(brute(texts, 15))
    assert phrases.collocations(docs_of(spark, [])).count() == 0
