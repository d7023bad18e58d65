import zlib

import pytest
from pyspark.sql import functions as F

from relaylens.llm import sharding
from relaylens.llm.queries import op13_sharding
from tests.llm.helpers import AWKWARD, table, write


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 97, 1000, 1025, 40_001])
def test_permutation_and_its_inverse(spark, n):
    """Every place once, and back again; sizes with and without cycle walks."""
    p = sharding.Permutation(n, seed=7)
    rows = p.inverse(p.forward(spark.range(n), "id", "at"), "at", "back")
    got = rows.agg(F.count_distinct("at"), F.min("at"), F.max("at"), F.sum((F.col("back") != F.col("id")).cast("int"))).first()
    assert tuple(got) == (n, 0, n - 1, 0)


def test_long_walks_stay_inside(spark):
    """A size with many numbers outside: walks of several steps happen."""
    n = 5
    p = sharding.Permutation(n, seed=1)
    p.a, p.b = 40, 40  # 1,595 of 1,600 numbers lie outside
    got = p.inverse(p.forward(spark.range(n), "id", "at"), "at", "back").collect()
    assert sorted(r.at for r in got) == list(range(n)) and all(r.back == r.id for r in got)


def test_seeds_and_sizes_shuffle(spark):
    n = 20_000
    a, b = sharding.Permutation(n, 1), sharding.Permutation(n, 2)
    rows = b.forward(a.forward(spark.range(n), "id", "a"), "id", "b")
    same, stay, corr, near = rows.agg(
        F.sum((F.col("a") == F.col("b")).cast("int")), F.sum((F.col("a") == F.col("id")).cast("int")), F.corr("id", "a"),
        F.sum((F.col("a") % 24 == F.col("id") % 24).cast("int")),
    ).first()
    assert same < 10 and stay < 10 and abs(corr) < 0.03 and abs(near / n - 1 / 24) < 0.01


def test_numbers_follow_the_rows_not_the_partitions(spark):
    rows = [(i % 50 if i % 7 else None, f"t{i % 30}") for i in range(400)]
    one = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    other = sharding.assign(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(13)).collect()
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, other), key=str)
    assert sorted(r.row for r in one) == list(range(400))
    order = [(r.doc_id is not None, r.doc_id or 0, r.text) for r in sorted(one, key=lambda r: r.row)]
    assert order == sorted(order)


def test_shard_and_slot_are_computable(spark):
    docs = table(spark, AWKWARD * 7)
    got = sharding.assign(docs.select("doc_id", "text"))
    n = len(AWKWARD) * 7
    kept = got.select("row", F.col("shard").alias("s"), F.col("slot").alias("t"))
    again = sharding.row_at(sharding.shard_and_slot(kept, "row", n), "s", "t", n, "r").collect()
    assert len(again) == n and all((r.shard, r.slot, r.row) == (r.s, r.t, r.r) for r in again)


def test_copies_are_spread_over_pieces(spark, monkeypatch):
    """A third of all rows equal: every copy gets its own place."""
    monkeypatch.setattr(sharding, "COPIES", 16)
    rows = [(5, "same")] * 1000 + [(None, "no id")] * 1000 + [(i, f"t{i}") for i in range(1000)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.row for r in got) == list(range(3000))
    assert sum(r.text == "same" for r in got) == 1000
    sizes = [sum(r.shard == s for r in got) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_query_on_awkward_rows(spark, tmp_path):
    d = write(spark, tmp_path, AWKWARD)
    got = op13_sharding(spark, d).collect()
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in AWKWARD)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard, r.slot) for r in got} == {("rows", None, 0)}
    assert len({r.shard for r in got}) == len(AWKWARD)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_documents(empty).count() == 0
    clash = spark.createDataFrame([(1, "a", "x", 9.5), (2, "b", None, 1.5)], "doc_id long, text string, shard string, row double")
    got = sharding.assign(clash)
    assert got.columns == ["doc_id", "text", "row", "shard", "slot"] and sorted(r.row for r in got.collect()) == [0, 1]


def test_main_path_has_no_python(spark):
    plan = sharding.shard_documents(table(spark, AWKWARD))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "ExistingRDD")), plan


def test_written_shards(spark, tmp_path):
    docs = table(spark, AWKWARD * 5, clashes=False)
    sharding.write_shards(docs, f"{tmp_path}/shards", shards=4)
    texts, n = [], 0
    for s in range(4):
        rows = sharding.read_shard(spark, f"{tmp_path}/shards", s).collect()
        assert [r.slot for r in rows] == list(range(len(rows)))
        texts += [(r.doc_id, r.text, r.source) for r in rows]
        n += len(rows)
    assert sorted(texts, key=str) == sorted(((i, t, "s") for i, t in AWKWARD * 5), key=str)
