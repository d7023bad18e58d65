from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relaylens.llm import ngram_join
from relaylens.llm.components import components
from relaylens.llm.queries import op2_ngram_jaccard_join
from tests.conftest import SF01
from tests.llm.helpers import AWKWARD, table


def ngram_set(text):
    words = (text or "").lower().split()
    if len(words) >= 5:
        return frozenset(zip(*[words[i:] for i in range(5)]))
    return frozenset([tuple(words)]) if words else frozenset()


def brute(rows):
    """(class, links) per row position, from exact set similarities."""
    sets = [ngram_set(t) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    parent, links = list(range(len(rows))), Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = Counter()
        for x in s:
            common.update(where[x])
        for j, k in common.items():
            if j > i and k >= 0.8 * (len(s) + len(sets[j]) - k) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = root(i)
        if key is not None:
            least[r] = min(least.get(r, key), key)
    return Counter((key, least.get(root(i)), links[i]) for i, (key, _) in enumerate(rows))


def same(df, rows):
    got = Counter(tuple(r) for r in df.select("doc_id", "class_id", "n_links").collect())
    assert got == brute(rows)


def near_copies(n, words=60, seed=0):
    """One text with a few words changed at the ends of each copy."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(0, words))] = f"x{int(rng.integers(0, 5))}"
        out.append(" ".join(w))
    return out


def test_plan_bands():
    bands, rows = ngram_join.plan_bands(0.8, 0.9995, 512)
    assert bands * rows <= 512 and 1 - (1 - 0.8**rows) ** bands >= 0.9995
    more = rows + 1
    need = np.log(1 - 0.9995) / np.log(1 - 0.8**more)
    assert np.ceil(need) * more > 512


def test_query_against_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF01}/documents.parquet'").fetchall()
    same(op2_ngram_jaccard_join(spark, SF01), rows)


@pytest.mark.parametrize("blocks", [False, True])
def test_group_of_near_copies(spark, monkeypatch, blocks):
    """All links of a group are found, also when its buckets and component
    are cut into blocks."""
    if blocks:
        monkeypatch.setattr(ngram_join, "BUCKET_NODES", 20)
        monkeypatch.setattr(ngram_join, "CELL_NODES", 16)
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(ngram_join, "PAIRWISE", 8)
    texts = near_copies(150) + near_copies(40, 30, 1) + [" ".join(f"q{i}_{k}" for i in range(40)) for k in range(20)]
    passage = " ".join(f"p{i}" for i in range(50))
    texts += [f"{passage} " + " ".join(f"own{k}_{i}" for i in range(60)) for k in range(60)]
    rows = list(enumerate(texts + texts[:5] * 3))
    same(ngram_join.near_duplicates(table(spark, rows)), rows)


def test_awkward_rows(spark):
    rows = AWKWARD + [(20, ngram_join_long()), (None, AWKWARD[0][1]), (21, "A"), (22, "one two three four"), (22, "five six seven eight")]
    same(ngram_join.near_duplicates(table(spark, rows)), rows)
    assert ngram_join.near_duplicates(table(spark, [])).count() == 0
    assert ngram_join.keep_one(table(spark, [])).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_rows_that_share_or_lack_an_id(spark, monkeypatch, few):
    """A third of the rows on one id, a third on none: the texts fetched grow
    with the rows, and no link is lost."""
    if not few:
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    fetched = []
    fetch = ngram_join.picked_texts

    def counted(docs, picks):
        out = fetch(docs, picks)
        fetched.append((out.count(), picks.count()))
        return out

    monkeypatch.setattr(ngram_join, "picked_texts", counted)
    texts = [" ".join(f"t{k}_{i}" for i in range(40)) + end for k in range(100) for end in ("", " x")]
    texts += ["the same text in many rows without any id at all"] * 50
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else 1000 + k, t) for k, t in enumerate(texts)]
    same(ngram_join.near_duplicates(table(spark, rows)), rows)
    assert fetched == [(200, 200)]


def test_groups_keep_one_row_per_member():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"key": [1, 1, 1], "node": [4, 4, 5]}), pa.RecordBatch.from_pydict({"key": [1, 2], "node": [5, 5]})]
    assert list(ngram_join.groups(iter(batches), 1)) == [[(1, 4), (1, 5)], [(2, 5)]]


def ngram_join_long():
    return AWKWARD[8][1] + " and one more"


def test_keep_one(spark):
    docs = table(spark, AWKWARD)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 8, 9]


def test_keep_one_by_text_where_ids_repeat(spark):
    """Every class keeps one row, whatever rows share an id or have none."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    rows = [(1, a), (5, a), (5, b), (7, b), (None, c), (None, c + " x"), (None, c), (None, d), (9, d), (9, ""), (9, None), (None, "")]
    rows += [(20, f"other text number {k} " + " ".join(f"o{k}_{i}" for i in range(20))) for k in range(6)]
    got = [(r.doc_id, r.text) for r in ngram_join.keep_one(table(spark, rows)).collect()]
    third = [r for r in got if r[1] and r[1].startswith("c0")]
    assert len(third) == 1 and third[0][0] is None
    rest = sorted((r for r in got if r not in third), key=str)
    assert rest == sorted([(1, a), (5, b), (9, d), (9, None), (None, ""), *rows[-6:]], key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=12, unique=True), min_size=2, max_size=10), st.booleans())
def test_verify_against_brute_force(words, cross):
    code = {c: np.uint64(i * 977) for i, c in enumerate("abcdefgh")}
    sets = [np.sort(np.array([code[c] for c in w], np.uint64)) for w in words]
    weights = np.arange(1, len(sets) + 1)
    blocks = np.arange(len(sets)) % 2
    links, _ = ngram_join.verify(sets, weights, blocks, 0, int(cross), 0.8)
    for i, a in enumerate(words):
        want = 0
        for j, b in enumerate(words):
            if i != j and not (cross and blocks[i] == blocks[j]) and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8 - 1e-12:
                want += weights[j]
        assert links[i] == want


def test_sketches_estimate_similarity():
    factors = ngram_join.factors_of(512)
    rng = np.random.default_rng(3)
    for share in (0.3, 0.8, 0.95):
        a = rng.integers(0, 1 << 62, 2000, dtype=np.uint64)
        keep = int(2000 * 2 * share / (1 + share))
        b = np.concatenate([a[:keep], rng.integers(0, 1 << 62, 2000 - keep, dtype=np.uint64)])
        low = ngram_join.minhashes([a, b], factors)
        assert abs((low[0] == low[1]).mean() - share) < 0.08


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 20), st.integers(-5, 20)), max_size=25))
def test_components_against_union_find(spark, edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {(x, root(x)) for x in parent if root(x) != x}
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert {tuple(r) for r in got.collect()} == want


def test_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.v for r in components(edges).collect()} == {0}
