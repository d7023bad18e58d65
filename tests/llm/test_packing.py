import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from relaylens.llm import packing
from relaylens.llm.tokens import load_tokenizer
from tests.llm.helpers import AWKWARD, table

WORD = public_tokenizers.path("word_bpe_49k.json")


def fewest(lengths, capacity):
    """The optimum by trying every placement."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in sorted(set(rooms)):
            if k >= lengths[i]:
                j = rooms.index(k)
                go(i + 1, rooms[:j] + [k - lengths[i]] + rooms[j + 1 :])
        go(i + 1, rooms + [capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_small_packings_are_optimal(lengths):
    got = packing.solve(lengths, 20)
    assert sorted(x for f in got for x in f) == sorted(lengths)
    assert max(map(sum, got)) <= 20
    assert len(got) == fewest(lengths, 20)


def test_search_beats_best_fit():
    rng, better = random.Random(3), 0
    for _ in range(300):
        lengths = [rng.randint(4, 12) for _ in range(12)]
        a, b = len(packing.solve(lengths, 24)), len(packing.best_fit(sorted(lengths, reverse=True), 24))
        assert a <= b
        better += a < b
    assert better


@pytest.mark.parametrize("lengths, capacity", [([11, 8, 7, 5, 5, 4], 20), ([60, 39, 38, 23, 20, 20], 100)])
def test_fillings_without_the_longest_sizes(lengths, capacity):
    got = packing.solve(lengths, capacity)
    assert sorted(x for f in got for x in f) == sorted(lengths)
    assert len(got) == fewest(lengths, capacity) == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(15, 70), min_size=1, max_size=10))
def test_wide_sizes_are_packed_optimally(lengths):
    assert len(packing.solve(lengths, 100)) == fewest(lengths, 100)


def test_dominance():
    stock = packing.Stock([5, 3, 3, 2])
    assert packing.dominated((3,), 2, stock)  # 5 fits in place of 3
    assert not packing.dominated((5,), 1, stock)
    assert packing.dominated((), 2, stock)


@pytest.mark.parametrize("group_sequences", [1, 1024])
def test_pack_is_whole(spark, group_sequences):
    capacity = 50
    cut = packing.pieces(table(spark, AWKWARD).repartition(2), WORD, 1, capacity)
    rows = packing.pack(cut, capacity, group_sequences).collect()
    tok = load_tokenizer(WORD)
    expected, want = 0, defaultdict(int)
    for key, text in AWKWARD:
        n = len(tok.encode(text or "", add_special_tokens=False).ids) + 1
        expected += n
        for k, at in enumerate(range(0, n, capacity)):
            want[key, k, at, min(capacity, n - at)] += 1
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length] += 1
    assert got == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    if group_sequences > 1:
        assert len(bins) <= -(-expected // capacity) + 1


def test_fitting_partners_are_dealt_alike(spark):
    """Two lengths that only fit each other, in equal numbers: no group may
    get more of one, or the packing is worse than the whole's."""
    rows = [(i, 0, 0, (30, 20)[i % 2], 7, 7) for i in range(3200)] + [(None, 0, 0, 50, 7, 7)] * 100
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES), 50, 17).collect()
    assert len(got) == len(rows)
    assert len({r.sequence_id >> 32 for r in got}) == 100
    assert len({r.sequence_id for r in got}) == 1700


def test_empty_table(spark):
    assert packing.pack(packing.pieces(table(spark, []), WORD, 1)).count() == 0


def test_placement_is_repeatable():
    import pandas as pd

    rng = np.random.default_rng(0)
    g = pd.DataFrame({"doc_id": range(300), "piece": 0, "start": 0, "length": rng.integers(1, 4096, 300), "ids_crc32": 1})
    a = packing.place(g.sample(frac=1, random_state=1)).sort_values("doc_id").reset_index(drop=True)
    b = packing.place(g.sample(frac=1, random_state=2)).sort_values("doc_id").reset_index(drop=True)
    assert a.equals(b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=9), st.sampled_from([24, 25]))
def test_no_packing_is_below_the_bound(lengths, capacity):
    assert -(-sum(lengths) // capacity) <= packing.least_sequences(lengths, capacity) <= fewest(lengths, capacity)


@pytest.mark.parametrize(
    "lengths, capacity, want",
    [
        ([], 100, 0),
        ([51] * 40, 100, 40),  # by volume 21
        ([60] * 10 + [50] * 10, 100, 15),  # by volume 11
        ([34] * 31, 100, 16),  # by volume 11
        ([26] * 30, 100, 10),  # by volume 8
        ([50] * 7 + [25] * 2, 100, 4),
    ],
)
def test_bound_by_size_classes(lengths, capacity, want, monkeypatch):
    assert packing.least_sequences(lengths, capacity) == want
    # the best fit reaches it, so no search begins
    monkeypatch.setattr(packing, "search", None)
    assert len(packing.solve(lengths, capacity)) == want


def test_gap_where_the_search_is_cut_off():
    """200 lengths of a sixth to a half: the node budget ends the search; what
    stays open is at most 3 of 70 sequences."""
    rng = random.Random(11)
    lengths = [rng.randint(700, 2000) for _ in range(200)]
    got = [len(packing.solve(lengths, 4096, nodes)) for nodes in (0, 600, 6_000)]
    least = packing.least_sequences(lengths, 4096)
    assert got == sorted(got, reverse=True)
    assert least <= got[-1] <= least + 3


def test_nodes_are_a_parameter_of_pack(spark):
    rows = [(i, 0, 0, n, 7, 7) for i, n in enumerate([11, 8, 7, 5, 5, 4])]
    cut = spark.createDataFrame(rows, packing.PIECES)
    for nodes, want in ((0, 3), (6_000, 2)):
        assert len({r.sequence_id for r in packing.pack(cut, 20, nodes=nodes).collect()}) == want


def test_query_on_the_given_table(spark):
    """The query packs every document of the table, whole."""
    import zlib

    from relaylens.llm.queries import op10_best_fit_packing

    sf = "/root/testdata/sf0.001"
    tok = load_tokenizer(WORD)
    want, total = [], 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        want += [(r.doc_id, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    got = op10_best_fit_packing(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        ends = np.cumsum([n for _, n in sorted(b)])
        assert [at for at, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(bins) <= -(-total // 4096) + 1
