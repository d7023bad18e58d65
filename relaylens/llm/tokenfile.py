"""Token files: every document's ids in one array, its boundaries in an
Elias-Fano list.

One file holds a contiguous run of documents in ascending ``doc_id`` order::

    ids         little-endian, 2 bytes while the vocabulary fits, else 4
    boundaries  Elias-Fano: end of each document in the array
    doc ids     Elias-Fano: doc_id minus the file's smallest
    footer      fixed size: counts, bit widths, section lengths, magic

so a reader seeks to the footer, then to any document by two ``select``
calls; no 64-bit table is kept.  ``write`` returns the manifest: one row per
file that a finished task wrote (files have attempt-unique names, so a lost
executor's half-written file is never named).  Rows without ``doc_id`` come
first.  A null text counts as empty: its document holds the end id alone.
Rows that repeat a ``doc_id`` (or have none) are kept, ordered by the 64-bit
hash of their text and, where that is equal too, by their place in the input:
files are cut at any of the three, so one id may fill many of them.  Other
columns are ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relaylens.llm.caches import claim
from relaylens.llm.eliasfano import EliasFano
from relaylens.llm.ship import open_fs, partitions, ship, whole_text
from relaylens.llm.tokens import BYTE_LEVEL, encoder

MAGIC = b"RLTOKEF1"
#: width, null ids, documents, tokens, smallest doc_id, then two lists of
#: (bit width, bytes of low, high and sample parts); magic.
FOOTER = struct.Struct("<IQQQq" + "IQQQ" * 2 + "8s")
READ_BYTES = 8 << 20
RUN_DOCS = 1 << 14

MANIFEST = "file string, part int, first_id long, n_docs long, n_tokens long"
ROWS = "doc_id long, local_start long, n_tokens long, ids_crc32 long, part int"


class TokenFile:
    """Random and sequential access to one file."""

    def __init__(self, handle):
        self.handle = handle
        size = handle.size()
        handle.seek(size - FOOTER.size)
        (self.width, self.n_null, self.n_docs, self.n_tokens, self.base, *lists, magic) = FOOTER.unpack(
            handle.read(FOOTER.size)
        )
        if magic != MAGIC:
            raise ValueError("not a token file")
        handle.seek(self.n_tokens * self.width)
        self.ends = self._list(self.n_docs, lists[:4])
        self.ids = self._list(self.n_docs - self.n_null, lists[4:])

    def _list(self, n: int, spec: list[int]) -> EliasFano:
        bits, *lengths = spec
        return EliasFano(n, bits, *[self.handle.read(k) for k in lengths])

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.base + self.ids.select(i - self.n_null)

    def tokens(self, i: int) -> np.ndarray:
        """The ids of document ``i`` (from 0), end id included."""
        start = self.ends.select(i - 1) if i else 0
        self.handle.seek(start * self.width)
        return np.frombuffer(self.handle.read((self.ends.select(i) - start) * self.width), f"<u{self.width}")

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of every document, reading the array once in
        runs of a few megabytes.  Boundaries and ids of documents are decoded
        ``RUN_DOCS`` at a time between select samples."""
        start = 0
        self.handle.seek(0)
        for a in range(0, self.n_docs, RUN_DOCS):
            b = min(a + RUN_DOCS, self.n_docs)
            ends = self.ends.run(a, b)
            keys = [None] * max(0, min(b, self.n_null) - a)
            keys += (self.ids.run(max(a - self.n_null, 0), b - self.n_null) + self.base).tolist()
            i = 0
            while i < b - a:
                j = max(i + 1, int(np.searchsorted(ends, start + READ_BYTES // self.width, "right")))
                run = np.frombuffer(self.handle.read((int(ends[j - 1]) - start) * self.width), f"<u{self.width}")
                at = 0
                for k in range(i, j):
                    n = int(ends[k]) - start - at
                    yield keys[k], start + at, run[at : at + n]
                    at += n
                i, start = j, int(ends[j - 1])


def write_file(handle, docs: Iterator[tuple[int | None, bytes]], width: int) -> tuple[int | None, int, int]:
    """Write documents (id, packed ids) in order; (first id, count, tokens)."""
    ends, keys, total, nulls = [], [], 0, 0
    for key, ids in docs:
        handle.write(ids)
        total += len(ids) // width
        ends.append(total)
        if key is None:
            nulls += 1
        else:
            keys.append(key)
    base = keys[0] if keys else 0
    lists = [EliasFano.build(np.array(ends, np.uint64)), EliasFano.build(np.array(keys, np.int64) - base)]
    spec: list[int] = []
    for ef in lists:
        parts = ef.parts()
        spec += [ef.bits, *map(len, parts)]
        for p in parts:
            handle.write(p)
    handle.write(FOOTER.pack(width, nulls, len(ends), total, base, *spec, MAGIC))
    return (None if nulls or not keys else base), len(ends), total


def write(docs: DataFrame, tokenizer: str, end_id: int, uri: str) -> DataFrame:
    """Encode every whole text, append ``end_id`` to each and write the
    files under ``uri``; the manifest, one row per file.

    Range partitions make the files ascend; each task sorts (spilling if it
    must) and streams its documents to its file.  The hash of the text and the
    place in the input split the rows of one doc_id over tasks.
    """
    spark = docs.sparkSession
    ship(spark)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokens")
        enc = encoder(tokenizer, BYTE_LEVEL)
        end = np.array([end_id], enc.dtype).tobytes()

        def rows(first: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
            for batch in chain([first], batches):
                for key, packed in zip(batch.column(0).to_pylist(), enc.encode_column(batch.column(1))):
                    yield key, packed + end

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        store, folder = open_fs(uri)
        store.create_dir(folder)
        name = f"tokens-{part:06d}-{uuid.uuid4().hex}.bin"
        with store.open_output_stream(f"{folder}/{name}") as f:
            key, n, total = write_file(f, rows(first), enc.width)
        yield pa.RecordBatch.from_pylist(
            [{"file": name, "part": part, "first_id": key, "n_docs": n, "n_tokens": total}],
            schema=pa.schema(
                [("file", pa.string()), ("part", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]
            ),
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    order = ["doc_id", "text_hash", "place"]
    placed = rows.select("*", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("place"))
    dealt = placed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    manifest = dealt.select("doc_id", "text").mapInArrow(task, MANIFEST)
    manifest.write.parquet(f"{uri}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")


def read(manifest: DataFrame, uri: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 (of the ids as 32-bit integers)."""
    ship(manifest.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_fs(uri)
        for batch in batches:
            for row in batch.to_pylist():
                out: list[tuple] = []
                with store.open_input_file(f"{folder}/{row['file']}") as f:
                    for key, start, ids in TokenFile(f).scan():
                        out.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), row["part"]))
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    # one row per file: what a window over all of them holds is bounded by
    # the number of tasks that wrote
    order = Window.orderBy(F.col("part")).rowsBetween(Window.unboundedPreceding, -1)
    base = manifest.select("part", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))
    files = manifest.select("file", "part").repartition(partitions(manifest.sparkSession), "file")
    rows = files.mapInArrow(task, ROWS)
    return rows.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("local_start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"
    )
