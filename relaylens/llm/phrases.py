"""Phrase collocations by mergeable Misra-Gries summaries.

Texts, lower-cased in A-Z, are cut at ``[.,;:!?`` and line ends ``]`` into
pieces and those into words; phrases are runs of 1 to ``LONGEST`` words inside
a piece, counted per language.  Everything that occurs ``LEAST`` times or
more is found and counted exactly, in two passes over the texts:

1. *Summaries.*  Every task counts the 64-bit hashes of the runs of a few
   megabytes of text at a time and sends the counts to ``parts`` hash
   partitions (the high half of a hash names the partition, the low half the
   run in it), one block per partition.  The number of partitions grows with
   the text, so a partition's mass (its sum of counts) is about
   ``PART_MASS`` at every size, but for runs that are frequent themselves,
   which take one entry per block.  (On a very large corpus a larger
   ``PART_MASS``, as executors allow, keeps blocks worth a row each.)  A partition merges its blocks into one
   Misra-Gries summary: counters add up, and when there are more than its
   capacity, the largest of the surplus counters is taken off all.  The
   capacity exceeds mass / ``LEAST``, so what was taken off is below ``LEAST``
   in total and every run that frequent survives.
2. *Exact counts.*  The survivors set bits in a filter of ``FILTER_BITS``
   (a fixed size, the only thing broadcast).  The second pass counts the runs
   whose bits are set, and those of all shorter runs in them, by their words;
   wrong bits only add rows that the count drops.  On more survivors than the
   filter tells apart the second pass ships more runs and stays exact.

The collocation score of a candidate (2 words or more) is that of its lowest
cut into two parts, in decimals of 38 digits.  A phrase is dropped if it lies
inside a longer candidate just as frequent; since a longer phrase is never
more frequent than one inside it, one more word at either side decides.

Null texts count as empty, a missing language as ``und``; repeated rows count
each time; a row's id is not read; an empty table gives no rows.  A text longer
than a block is read in several, cut where pieces end.  Ties: score and
frequency descending, then the phrase's UTF-8 bytes ascending.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relaylens.llm.ship import partitions, ship, small, to_table

LEAST, LONGEST, TOP = 100, 5, 2_000
#: Expected sum of counts of a hash partition, text read at once, and the
#: survivors' filter (16 MB), in segments.
PART_MASS, BLOCK_CHARS = 2_000_000, 2_000_000
#: Hash partitions per task, so that tasks are even; pieces a language's
#: phrases are dealt to.
TASK_PARTS, SALTS = 4, 64
FILTER_BITS, SEGMENTS = 1 << 27, 64
SEGMENT_BITS = FILTER_BITS // SEGMENTS
#: Pending entries of a partition before they are merged into its summary.
PENDING = 1_000_000

BREAK = "[.,;:!?\\x0A-\\x0D]"
_BREAK = re.compile(BREAK)
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz,,,,,,,,,")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_SEED = 17

BLOCKS = "part int, kind int, mass long, keys binary, counts binary"
COUNTED = "lang string, n int, phrase string, f long"


class Words:
    """The words of some text of one language: ids, breaks and run hashes."""

    def __init__(self, lang: str, texts: list[str]):
        joined = " , ".join(texts).encode("utf-8", "replace")
        self.tokens = joined.translate(_TABLE).replace(b",", b" , ").split()
        vocabulary = dict.fromkeys(self.tokens)
        for i, w in enumerate(vocabulary):
            vocabulary[w] = i
        self.size = max(1, len(vocabulary))
        self.ids = np.fromiter(map(vocabulary.__getitem__, self.tokens), np.int64, len(self.tokens))
        seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "replace"), _SEED)
        hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in vocabulary], np.uint64)
        n = len(self.ids)
        self.first = hashes[self.ids] if n else np.zeros(0, np.uint64)
        # words from a place to the next break
        breaks = np.where(self.ids == vocabulary.get(b",", -1), np.arange(n), n)
        self.left = np.minimum.accumulate(breaks[::-1])[::-1] - np.arange(n) if n else breaks
        self.words = int((self.left > 0).sum())

    def runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, places, hashes) of the runs of n words, n ascending."""
        places = np.flatnonzero(self.left >= 1)
        h = self.first[places]
        for n in range(1, LONGEST + 1):
            if n > 1:
                keep = self.left[places] >= n
                places = places[keep]
                h = h[keep] * _MIX + self.first[places + (n - 1)]
                h ^= h >> np.uint64(29)
            yield n, places, spread(h)

    def count(self, bits: np.ndarray, parts: int) -> Iterator[tuple[int, str, int]]:
        """(n, phrase, times) of the runs whose bits, and those of all runs
        in them, are set; told apart by their words."""
        kept = group = None
        for n, places, h in self.runs():
            part, key = addresses(h, parts)
            segment, at = bits_of(part, key)
            at = segment * np.uint64(SEGMENT_BITS) + at
            ok = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            if n > 1:
                ok &= kept[places] & kept[places + 1]
            places = places[ok]
            # a run of n words is its first n - 1 (by group) and its last
            pair = self.ids[places] if n == 1 else group[places] * self.size + self.ids[places + (n - 1)]
            _, first, back, times = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
            for p, f in zip(places[first].tolist(), times.tolist()):
                yield n, b" ".join(self.tokens[p : p + n]).decode("utf-8", "replace"), f
            kept, group = np.zeros(len(self.ids) + 1, bool), np.zeros(len(self.ids), np.int64)
            kept[places], group[places] = True, back


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX2
    return h ^ (h >> np.uint64(32))


def addresses(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition and key within it."""
    return (h >> np.uint64(32)) % np.uint64(parts), h & np.uint64(0xFFFFFFFF)


def bits_of(part: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment and bit of a run in the filter."""
    h = spread((part + np.uint64(1)) * _MIX ^ key)
    return part % np.uint64(SEGMENTS), h % np.uint64(SEGMENT_BITS)


def slices(text: str) -> Iterator[str]:
    """A long text in pieces of about ``BLOCK_CHARS``, cut at breaks."""
    at = 0
    while len(text) - at > BLOCK_CHARS and (m := _BREAK.search(text, at + BLOCK_CHARS)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:] if at else text


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, "Words"]]:
    """The words of about ``BLOCK_CHARS`` characters at a time, by language."""
    held: dict[str, list[str]] = {}
    chars = 0
    for batch in small(batches, 500):
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lang, text in zip(langs, texts):
            for piece in slices(text or ""):
                held.setdefault("und" if lang is None else lang, []).append(piece)
                chars += len(piece)
                if chars >= BLOCK_CHARS:
                    yield {k: Words(k, v) for k, v in held.items()}
                    held, chars = {}, 0
    if held:
        yield {k: Words(k, v) for k, v in held.items()}


def _counted(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("mass", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
        for block in blocks(batches):
            hashes = [h for w in block.values() for _, _, h in w.runs()]
            part, key = addresses(np.concatenate(hashes), parts)
            found, times = np.unique((part << np.uint64(32)) | key, return_counts=True)
            del hashes, part, key
            part = (found >> np.uint64(32)).astype(np.int64)
            key, times = (found & np.uint64(0xFFFFFFFF)).astype("<u4"), np.minimum(times, 0xFFFFFFFF).astype("<u4")
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            rows = []
            for a, b in zip(starts, np.append(starts[1:], len(part))):
                p, mass = int(part[a]), int(times[a:b].sum(dtype=np.int64))
                rows.append((p, 0, mass, None, None))
                rows.append((p, 1, 0, key[a:b].tobytes(), times[a:b].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


class MisraGries:
    """A summary of keys with counts: at most ``capacity`` counters, each
    short of the true count by ``error`` at most, missing keys too."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counters (keys may repeat)."""
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts
        if len(keys) > self.capacity:
            surplus = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.error += surplus
            keep = counts > surplus
            keys, counts = keys[keep], counts[keep] - surplus
        self.keys, self.counts = keys, counts

    def at_least(self, least: int) -> np.ndarray:
        """All keys that may count ``least`` or more."""
        return self.keys[self.counts + self.error >= least]


def _summarised(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        part, mass, summary, keys, counts, pending = None, 0, None, [], [], 0

        def merged():
            nonlocal keys, counts, pending
            if keys:
                summary.merge(np.concatenate(keys), np.concatenate(counts))
            keys, counts, pending = [], [], 0

        def done():
            if summary is None:
                return None
            merged()
            left = summary.at_least(least)
            row = pd.DataFrame({"segment": [part % SEGMENTS], "part": [part], "keys": [left.astype("<u4").tobytes()]})
            return pa.RecordBatch.from_pandas(row.astype({"segment": "int32", "part": "int32"}), preserve_index=False)

        for batch in batches:
            for r in small([batch], 64):
                for p, kind, m, k, c in zip(*[r.column(i).to_pylist() for i in range(5)]):
                    if p != part:
                        if (row := done()) is not None:
                            yield row
                        part, mass, summary = p, 0, None
                    if kind == 0:  # the masses of a partition come before its blocks
                        mass += m
                        continue
                    if summary is None:
                        summary = MisraGries(mass // least + 1)
                    keys.append(np.frombuffer(k, "<u4"))
                    counts.append(np.frombuffer(c, "<u4").astype(np.int64))
                    pending += len(keys[-1])
                    if pending > max(PENDING, summary.capacity):
                        merged()
        if (row := done()) is not None:
            yield row

    return run


def _segment(rows: pd.DataFrame) -> pd.DataFrame:
    """One segment of the filter, from the survivors of its partitions."""
    bits = np.zeros(SEGMENT_BITS // 8, np.uint8)
    for part, keys in zip(rows["part"], rows["keys"]):
        _, at = bits_of(np.array([part], np.uint64), np.frombuffer(keys, "<u4").astype(np.uint64))
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))
    return pd.DataFrame({"segment": [int(rows["segment"].iloc[0])], "bits": [bits.tobytes()]})


def survivors(docs: DataFrame, least: int) -> tuple[bytes, int]:
    """The filter of all runs that may occur ``least`` times, and the number
    of hash partitions."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a run of each length at most per two bytes of text, mostly one per six
    parts = max(partitions(spark), -(-int(size) * LONGEST // 6 // PART_MASS))
    tasks = max(partitions(spark), parts // TASK_PARTS)
    sent = docs.mapInArrow(_counted(parts), BLOCKS).repartition(tasks, "part").sortWithinPartitions("part", "kind")
    kept = sent.mapInArrow(_summarised(least), "segment int, part int, keys binary")
    segments = kept.groupBy("segment").applyInPandas(_segment, "segment int, bits binary")
    whole = bytearray(FILTER_BITS // 8)  # at most SEGMENTS rows: the filter's fixed size
    for r in segments.toLocalIterator():
        whole[r.segment * SEGMENT_BITS // 8 : (r.segment + 1) * SEGMENT_BITS // 8] = r.bits
    return bytes(whole), parts


def _exact(filter_bits: Broadcast, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(filter_bits.value, np.uint8)
        schema = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
        for block in blocks(batches):
            for lang, words in block.items():
                rows = [(lang, 0, "", words.words), *((lang, n, p, f) for n, p, f in words.count(bits, parts))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def count_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, n, phrase, f) of all runs of 1 to ``LONGEST`` words that occur
    ``least`` times in their language, and per language the row n = 0, whose
    f counts all words.  ``docs`` has ``lang`` and ``text``."""
    spark = docs.sparkSession
    ship(spark)
    read = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    filter_bits, parts = survivors(read, least)
    runs = read.mapInArrow(_exact(spark.sparkContext.broadcast(filter_bits), parts), COUNTED)
    sums = runs.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))
    return to_table(sums.where((F.col("n") == 0) | (F.col("f") >= least)), "phrase-counts")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a (its
    frequency), l and r (of the parts of its lowest cut), n (all words of the
    language), score."""
    counts = count_runs(docs, least)
    # a language may have most phrases: they are dealt to SALTS pieces
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt")
    n = counts.where(F.col("n") == 0).select("lang", F.col("f").alias("n_words"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    runs = counts.where(F.col("n") > 0).select("lang", "phrase", "f")
    found = counts.where(F.col("n") > 1).select("lang", "phrase", "n", F.col("f").alias("a"), F.split("phrase", " ").alias("ws"))

    longer = found.where(F.col("n") > 2).select(
        "lang",
        F.explode(F.array(F.expr("array_join(slice(ws, 1, n - 1), ' ')"), F.expr("array_join(slice(ws, 2, n - 1), ' ')"))).alias("phrase"),
        "a",
    )
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    alone = found.join(longer, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.col("around") < F.col("a")))

    cuts = alone.select("lang", "phrase", "a", "ws", "n", F.explode(F.expr("sequence(1, n - 1)")).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(ws, 1, k), ' ')").alias("left"), F.expr("array_join(slice(ws, k + 1, n - k), ' ')").alias("right")
    )
    cuts = cuts.join(runs.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(runs.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.select("*", salt).join(n, ["lang", "salt"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n_words", "l", "r")}
    score = F.call_function("div", (wide["a"] * wide["n_words"]).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)"), wide["l"] * wide["r"])
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    best = cuts.groupBy("lang", "salt", "phrase", "a", "n_words").agg(lowest)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = best.select("lang", "salt", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("n_words").alias("n"), F.col("cut.score").alias("score"))
    # the top of each piece, then of the language: SALTS * top rows at most
    for by in (["lang", "salt"], ["lang"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
