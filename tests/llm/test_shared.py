"""The helpers that operators share."""

import zlib

from pyspark.sql import functions as F

from relaylens.llm import caches
from relaylens.llm.labelled import held_out, labelled_sample
from relaylens.llm.ship import open_fs, ship, to_table
from tests.llm.helpers import AWKWARD, table, write


def test_a_claim_drops_the_other_caches(monkeypatch):
    monkeypatch.setattr(caches, "_CLEAR", {})
    monkeypatch.setattr(caches, "_OWNER", [])
    a, b = {1: 1}, {2: 2}
    caches.register("a", a.clear)
    caches.register("b", b.clear)
    caches.claim("a")
    assert a and not b
    a[3] = 3
    caches.claim("a")
    assert len(a) == 2
    caches.claim("b")
    assert not a


def test_held_out_is_the_stated_fifth(spark):
    df = spark.createDataFrame([(i,) for i in [*range(200), -7, 2**40, None]], "doc_id long").withColumn("out", held_out())
    for r in df.collect():
        assert r.out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_labelled_sample(spark, tmp_path):
    rows = AWKWARD + [(100 + i, f"text {i}") for i in range(100)]
    labels = [(100 + i, i % 2, 0) for i in range(100)] + [(7, 1, 0), (7, 0, 0), (None, 1, 1), (8, None, 1)]
    folder = write(spark, tmp_path, rows, labels)
    docs = table(spark, rows)
    got = labelled_sample(docs, folder, F.col("quality"), 1_000).collect()
    learned = [i for i in [7, *range(100, 200)] if zlib.crc32(str(i).encode()) % 5]
    # a repeated document is there once, with its largest grade
    assert sorted(r.doc_id for r in got) == sorted(learned)
    assert all(r.grade == 1 for r in got if r.doc_id == 7)
    few = labelled_sample(docs, folder, F.col("quality"), 10)
    assert few.select("doc_id").distinct().count() == 10
    hot = table(spark, rows + [(101, f"copy {i}") for i in range(300)] + [(None, "no id")] * 300)
    assert labelled_sample(hot, folder, F.col("quality"), 1_000).count() == len(learned)
    again = labelled_sample(docs.repartition(5), folder, F.col("quality"), 10)
    assert {r.doc_id for r in few.collect()} == {r.doc_id for r in again.collect()}


def test_written_tables_and_paths(spark):
    df = to_table(spark.range(5), "test-table")
    assert df.inputFiles() and df.count() == 5
    assert open_fs("file:///tmp/x")[1] == "/tmp/x" == open_fs("file:/tmp/x")[1] == open_fs("/tmp/x")[1]
    ship(spark)
    ship(spark)  # once per application
