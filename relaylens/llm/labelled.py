"""A bounded sample of labelled documents to fit classifiers on."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens.llm.ship import whole_text

HELD_OUT_OF = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(False))


def labelled_sample(docs: DataFrame, sf_dir: str, grade: Column, bound: int) -> DataFrame:
    """(doc_id, text, grade) of at most ``bound`` labelled documents outside
    the held-out fifth, the smallest by a hash of their id.

    ``bound`` is the documented limit of what a classifier is fitted on: the
    ids picked are at most that many, which bounds the broadcast, and of
    documents that share an id one stays (the smallest by a hash of its text,
    kept by a partial aggregate), which bounds the rows.  Repeated labels of
    an id count once (largest grade); null labels are left out.
    """
    labels = docs.sparkSession.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade"))
        .where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("grade").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")
    found = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "grade").agg(one)
    return found.select("doc_id", F.col("one.text").alias("text"), "grade")
