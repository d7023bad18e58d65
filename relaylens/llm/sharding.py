"""Sharding: a reproducible shuffle whose shard and slot can be computed.

Rows get global numbers 0 to N - 1, a keyed Feistel permutation of that range
gives each row its place in the shuffle, and place ``p`` lies in shard
``p mod shards`` at slot ``p div shards``.  So shard sizes differ by one row
at most, slots are gapless, and from a row number alone (or, backwards, from
a shard and a slot) anyone can compute the other without a lookup table.

**Numbers.** Rows are numbered in ascending order of all their columns, in
the order of the columns, nulls first.  So a number depends on the rows alone,
never on files or partitions.  Rows equal in every column are collapsed into
one with a count before anything is shuffled (a partial aggregate, so a row
that makes up a third of the table costs one row per task), the distinct rows
are range-partitioned (no ties, so ranges are even), counted per range and
numbered by a window inside each range; copies are written out again last, in
pieces of ``COPIES`` dealt over the tasks.  No task sees all rows, and what is
broadcast is one row per range (the session's partition count).

**Permutation.** ``a * b >= N`` with ``a`` and ``b`` near the square root; a
number is the pair ``(x div b, x mod b)`` and rounds add a keyed function of
one half to the other, alternately.  ``a * b`` passes N by less than ``a``:
results outside are permuted again until they lie inside (cycle walking).  A
walk visits each outside number once at most, so ``a * b - N`` steps always
suffice, and one row in sqrt(N) or fewer takes a step at all.

Everything is DataFrame functions: no Python worker, no pandas, no RDD.

Any column may be null, texts may be empty; equal rows get different places;
an empty table gives no rows.  Columns of the input named like an output
(``row``, ``shard``, ``slot``) are replaced by it.  Columns must have an order
(no maps).
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaylens.llm.ship import partitions, to_table

SHARDS, SEED, ROUNDS = 24, 20_260, 8
#: Copies of one row written out by one task at a time.
COPIES = 65_536
#: Fixed values of the round function: a prime modulus below 2**31 and two
#: multipliers below it, so that products stay inside 64 bits.
PRIME, FIRST, SECOND = 2_147_483_647, 1_103_515_245, 1_812_433_253
OUTPUTS = ("row", "shard", "slot")


def _div(x: Column, y: int) -> Column:
    return F.call_function("div", x, F.lit(y).cast("long"))


def _mod(x: Column, y: int) -> Column:
    return x % F.lit(y).cast("long")


class Permutation:
    """The permutation of ``0 .. n - 1`` for a seed.

    ``forward`` and ``inverse`` add it to a DataFrame a round per projection,
    so that expressions stay small: each round names its halves once."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        if not 0 <= n < 1 << 60:
            raise ValueError("a permutation needs a size from 0 to 2**60 - 1")
        self.n = max(1, n)
        self.a = math.isqrt(self.n - 1) + 1
        self.b = -(-self.n // self.a)
        digests = [hashlib.sha256(f"{seed}:{i}".encode()).digest() for i in range(rounds)]
        self.keys = [tuple(int.from_bytes(d[j : j + 4], "big") % PRIME for j in (0, 4)) for d in digests]

    @property
    def walk(self) -> int:
        """The most steps a cycle walk can take."""
        return self.a * self.b - self.n

    def _keyed(self, half: Column, key: tuple[int, int]) -> Column:
        v = _mod(_mod(half + F.lit(key[0]).cast("long"), PRIME) * F.lit(FIRST).cast("long"), PRIME)
        return _mod(v.bitwiseXOR(F.lit(key[1]).cast("long")) * F.lit(SECOND).cast("long"), PRIME)

    def _round(self, left: Column, right: Column, i: int, back: bool) -> tuple[Column, Column]:
        half, other, size = (left, right, self.a) if i % 2 == 0 else (right, left, self.b)
        moved = self._keyed(other, self.keys[i])
        half = _mod(half + (F.lit(size).cast("long") - _mod(moved, size) if back else moved), size)
        return (half, right) if i % 2 == 0 else (left, half)

    def _order(self, back: bool) -> list[int]:
        return list(range(len(self.keys)))[:: -1 if back else 1]

    def _step(self, x: Column, back: bool) -> Column:
        """One application as a single expression, for the walk."""
        left, right = _div(x, self.b), _mod(x, self.b)
        for i in self._order(back):
            left, right = self._round(left, right, i, back)
        return left * F.lit(self.b).cast("long") + right

    def _apply(self, df: DataFrame, column: str, out: str, back: bool) -> DataFrame:
        left, right, names = F.col("__left"), F.col("__right"), [c for c in df.columns if c != out]
        df = df.withColumn("__left", _div(F.col(column), self.b)).withColumn("__right", _mod(F.col(column), self.b))
        for i in self._order(back):
            halves = self._round(left, right, i, back)
            df = df.withColumn("__left", halves[0]) if i % 2 == 0 else df.withColumn("__right", halves[1])
        df = df.withColumn("__once", left * F.lit(self.b).cast("long") + right)
        place, inside = F.col("__once"), lambda p: p < F.lit(self.n).cast("long")
        if self.walk:
            steps = F.sequence(F.lit(1), F.lit(self.walk))
            walked = F.aggregate(steps, place, lambda p, _: F.when(inside(p), p).otherwise(self._step(p, back)))
            place = F.when(inside(place), place).otherwise(walked)
        return df.select(*names, place.alias(out))

    def forward(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """``df`` with the place of row number ``column`` in ``out``."""
        return self._apply(df, column, out, False)

    def inverse(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """``df`` with the row number at place ``column`` in ``out``."""
        return self._apply(df, column, out, True)


def shard_and_slot(df: DataFrame, row: str, n: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` of a row number among ``n``."""
    names = [c for c in df.columns if c not in ("shard", "slot")]
    placed = Permutation(n, seed).forward(df.select(*names), row, "__place")
    return placed.select(*names, _mod(F.col("__place"), shards).cast("int").alias("shard"), _div(F.col("__place"), shards).alias("slot"))


def row_at(df: DataFrame, shard: str, slot: str, n: int, out: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with the row number found at a slot of a shard in ``out``."""
    names = [c for c in df.columns if c != out]
    place = (F.col(slot) * F.lit(shards).cast("long") + F.col(shard)).alias("__place")
    return Permutation(n, seed).inverse(df.select(*names, place), "__place", out).select(*names, out)


def number_rows(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with their global number in ``row`` (from 0), and N."""
    spark = rows.sparkSession
    ranges = partitions(spark)
    names = [c for c in rows.columns if c != "row"]
    keys = [f"c{i}" for i in range(len(names))]
    plain = rows.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, keys)])
    distinct = plain.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    ordered = [F.col(k).asc_nulls_first() for k in keys]
    ranged = distinct.repartitionByRange(ranges, *ordered).withColumn("part", F.spark_partition_id())
    ranged = to_table(ranged, "row-ranges")

    # one row per range: at most the session's partition count
    sizes = ranged.groupBy("part").agg(F.sum("n").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")).alias("start"))
    total = int(sizes.agg(F.sum("size")).first()[0] or 0)

    inside = Window.partitionBy("part").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(inside), F.lit(0).cast("long"))
    firsts = ranged.withColumn("first", first).join(F.broadcast(starts), "part")
    firsts = firsts.select(*keys, "n", (F.col("start") + F.col("first")).alias("first"))

    few = firsts.where(F.col("n") <= COPIES)
    many = firsts.where(F.col("n") > COPIES)
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("n") - 1, COPIES))).alias("piece")
    many = many.select(*keys, "first", "n", pieces).repartition(ranges, "first", "piece")
    many = many.select(
        *keys,
        (F.col("first") + F.col("piece") * COPIES).alias("first"),
        F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("piece") * COPIES).alias("n"),
    )
    numbered = few.select(*keys, "first", "n").unionByName(many)
    numbered = numbered.select(*keys, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("row"))
    return numbered.select(*[F.col(k).alias(c) for c, k in zip(names, keys)], "row"), total


def assign(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``row``, ``shard`` and ``slot``."""
    names = [c for c in rows.columns if c not in OUTPUTS]
    numbered, n = number_rows(rows.select(*[F.col(f"`{c}`") for c in names]))
    packed = numbered.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), "row")
    return shard_and_slot(packed, "row", n, shards, seed).select("doc.*", "row", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Whole rows as Parquet, a folder per shard, rows by slot.

    Places are given to digests of the rows, so whole rows are shuffled twice
    only: once to keep one of each digest, once to their shard.  A shard is
    as many files as its share of the partitions, in the order of slots."""
    names = [c for c in docs.columns if c not in OUTPUTS]
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    keyed = docs.select(row.alias("doc"), F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256).alias("digest"))
    placed = assign(keyed.select("digest"), shards, seed)
    whole = placed.join(keyed.groupBy("digest").agg(F.first("doc").alias("doc")), "digest")
    out = whole.select("doc.*", "row", "shard", "slot")
    out.repartitionByRange(partitions(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """One shard's rows in the order of slots (only its folder is read)."""
    return spark.read.parquet(path).where(F.col("shard") == shard).orderBy("slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Documents (``doc_id``, ``text``) put into shards by the law ``rows``:
    counts at most one apart.  ``size`` is the text's UTF-8 bytes plus 8, a
    missing text counts none and has the checksum of an empty one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return assign(narrow, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row"
    )
