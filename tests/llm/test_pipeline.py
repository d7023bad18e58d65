from collections import defaultdict

import corpus_pipeline
import __spark_entry__ as E
from relaylens.llm import packing
from tests.conftest import SF001
from tests.llm.helpers import AWKWARD, table, write
from tests.llm.test_filters import brute_rules
from tests.llm.test_ngram_join import brute


def test_registered():
    names = set(E.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1


def test_stages_in_order(spark, tmp_path):
    """Each stage's decisions against brute force on its own input."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "best-fit packing"]
    frames = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, frames[-1], SF001).write.parquet(path)
        frames.append(spark.read.parquet(path))
        if i < 3:
            assert frames[-1].columns == docs.columns
    rows = [{r.doc_id: r for r in f.collect()} for f in frames[:4]]
    for before, after in zip(rows, rows[1:]):
        assert all(before[k] == r for k, r in after.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    assert all(k in rows[1] for k in rows[0] if labels.get(k) == 1)
    assert set(rows[2]) == {k for k, r in rows[1].items() if brute_rules(r.text or "")[6]}
    classes = brute([(k, r.text) for k, r in rows[2].items()])
    assert set(rows[3]) == {c for _, c, _ in classes}
    packed = frames[4].collect()
    assert {r.doc_id for r in packed} == set(rows[3])
    used = defaultdict(int)
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= packing.CAPACITY
    assert len(used) <= -(-sum(used.values()) // packing.CAPACITY) + 1
    # the whole run gives the same pieces
    again = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF001).collect()}
    assert again == {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed}


def test_awkward_and_empty_documents(spark, tmp_path):
    for name, rows in (("a", AWKWARD), ("b", [])):
        folder = write(spark, tmp_path / name, rows, [(1, 1, 0), (5, 0, 0)] if rows else [])
        corpus_pipeline.run(spark, folder).collect()
        docs = table(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
        assert docs.columns == table(spark, rows).columns
        docs.collect()
