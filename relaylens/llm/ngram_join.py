"""Near-duplicate join on word n-grams: MinHash banding, then verification
on the full n-gram sets.

1. Every text becomes the set of its n-grams (``NGRAM`` lower-case words,
   hashed to 64 bits; a shorter text is one n-gram of all its words).  Texts
   with equal sets are copies: they collapse to one *node* with a weight
   before anything is compared.
2. ``bands x rows`` MinHash values per node; ``plan_bands`` takes the most
   rows per band for which the wanted recall at the threshold still fits in
   ``HASHES`` values.  Rows are shuffled on band hashes; only buckets of two
   nodes or more go on, with short sketches instead of sets.
3. In a bucket, pairs whose sketches could belong to similar sets
   (``SKETCH_LINK``, many standard errors below the threshold) are linked.
   Large buckets use pivots: what is within ``PIVOT_COVER`` of a pivot needs
   no other one, because set distance is a metric.  Only a spanning forest
   leaves a bucket, never its pairs.
4. Components of those links bound where similar texts can be.  Each one's
   full sets are compared exactly, all pairs that can reach the threshold,
   over an inverted index; a task emits a count per node and a forest.
5. Components of verified links are the classes.

Buckets and components above a size are cut into blocks by hash, and every
pair of blocks is a cell, so no task holds more than two blocks and no pair
is missed.  Result: one row per document with its class (the smallest
doc_id in it) and its number of links: all other rows that are similar,
copies included.

Texts without words (null, empty) have no n-grams and link to nothing: their
class is their own doc_id.  Repeated rows are copies of each other.  Rows
without doc_id take part; a class of such rows alone has a null class_id.
Columns other than doc_id and text are not read; an empty table gives no
rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaylens.llm.caches import claim, register
from relaylens.llm.components import components
from relaylens.llm.ship import partitions, ship, to_table, whole_text

NGRAM, THRESHOLD = 5, 0.8
RECALL, HASHES = 0.9995, 512
#: Sketch: 16 bits of so many MinHash values; its error at the threshold is
#: sqrt(0.8 * 0.2 / 128) = 0.035.
SKETCH = 128
SKETCH_LINK, PIVOT_COVER, PAIRWISE = 0.55, 0.95, 64
#: Block sizes of buckets (nodes) and components (nodes, n-grams).
BUCKET_NODES, CELL_NODES, CELL_NGRAMS = 8_192, 1_024, 2_000_000
#: Largest side that is broadcast, in rows of three numbers.
BROADCAST_ROWS = 250_000
SLICE_NGRAMS = 200_000
CACHE_WORDS = 250_000
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

_WORDS: dict[str, int] = {}
register("ngrams", _WORDS.clear)


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band, hence the fewest chance
    collisions, whose bands reach the recall at the threshold."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > hashes:
            return best
        best = (bands, rows)
    return best


def ngrams(text: str, n: int = NGRAM) -> np.ndarray:
    """The sorted set of a text's n-grams as 64-bit hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = list(map(_WORDS.get, words))
    if None in codes:
        for i, c in enumerate(codes):
            if c is None:
                codes[i] = c = xxhash.xxh64_intdigest(words[i])
                if len(_WORDS) < CACHE_WORDS:
                    _WORDS[words[i]] = c
    code = np.array(codes, np.uint64)
    run = code
    for k in range(1, min(n, len(words))):
        run = run[:-1] * BASE + code[k:]
    run = (run ^ (run >> np.uint64(31))) * MIX
    return np.unique(run ^ (run >> np.uint64(29)))


def minhashes(sets: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
    """Row per set, column per factor: the least product modulo 2**64."""
    out = np.empty((len(sets), len(factors)), np.uint64)
    at = 0
    while at < len(sets):
        end, total = at + 1, len(sets[at])
        while end < len(sets) and total + len(sets[end]) <= SLICE_NGRAMS:
            total += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        sizes = np.array([len(s) for s in sets[at:end]])
        starts = np.cumsum(sizes) - sizes
        product = np.empty_like(flat)
        for j, f in enumerate(factors):
            np.multiply(flat, f, out=product)
            out[at:end, j] = np.minimum.reduceat(product, starts)
        at = end
    return out


def factors_of(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def profiles(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, node (hash of the n-gram set, null without words), n (set
    size), buckets (a number per band), sketch, text_hash."""
    ship(docs.sparkSession)
    factors = factors_of(max(bands * rows, SKETCH))
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("buckets", pa.list_(pa.int64())), ("sketch", pa.binary()), ("text_hash", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngrams")
        for batch in batches:
            # a few megabytes at a time keep the hashes small beside the texts
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = [ngrams(t, n) for t in part.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                cols: list[list] = [[None] * len(sets) for _ in range(3)]
                if full:
                    low = minhashes([sets[i] for i in full], factors)
                    band = low[:, : bands * rows].reshape(len(full), bands, rows)
                    key = np.full((len(full), bands), np.uint64(0)) + np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        key = (key * BASE + band[:, :, r]) * MIX
                        key ^= key >> np.uint64(32)
                    sketch = (low[:, :SKETCH] >> np.uint64(32)).astype("<u2")
                    for i, k, s in zip(full, key.astype(np.int64), sketch):
                        node = xxhash.xxh64_intdigest(sets[i].tobytes())
                        cols[0][i], cols[1][i], cols[2][i] = node - (1 << 63), k, s.tobytes()
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(cols[0], pa.int64()), sizes, pa.array(cols[1], schema.types[3]), pa.array(cols[2], pa.binary()), part.column(2)],
                    schema=schema,
                )

    return hashed_texts(docs).mapInArrow(task, "doc_id long, node long, n long, buckets array<long>, sketch binary, text_hash long")


def hashed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_hash: rows that share an id, or have none, are told
    apart by the hash."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.withColumn("text_hash", F.xxhash64("text"))


class Forest:
    """Union-find over 0..n-1; the smallest member is a set's root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, others: np.ndarray) -> None:
        a = self.root(i)
        for j in others.tolist():
            b = self.root(j)
            if a != b:
                a, b = min(a, b), max(a, b)
                self.parent[b] = a


def groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray | list]]:
    """Runs of rows that agree in the first ``width`` columns, across batch
    borders (rows come sorted by them and one more column; of rows that agree
    in that too the first stays)."""
    held: list[list] = []
    last: tuple | None = None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols):
            if row[:width] != last:
                if held:
                    yield held
                held, last = [], row[:width]
            if not held or held[-1][width] != row[width]:
                held.append(row)
    if held:
        yield held


def cells(rows: DataFrame, key: str, blocks: str, node: str = "node") -> DataFrame:
    """Each row once per cell it belongs to: ``key`` is cut into ``blocks``
    blocks by hash, and cell (i, j), i <= j, holds blocks i and j.  Adds
    i, j and the row's own block."""
    own = F.pmod(F.xxhash64(F.col(node), F.lit(11)), F.col(blocks)).cast("int")
    return (
        rows.withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .drop("other")
    )


def sketch_links(nodes: list[int], sketches: np.ndarray) -> list[tuple[int, int]]:
    """A forest (node, root) over pairs whose sketches agree enough."""
    m = len(nodes)
    forest = Forest(m)
    need = SKETCH_LINK * SKETCH
    if m <= PAIRWISE:
        agree = (sketches[:, None, :] == sketches[None, :, :]).sum(axis=2)
        for i in range(m):
            forest.join(i, np.flatnonzero(agree[i, i + 1 :] >= need) + i + 1)
    else:
        left = np.arange(m)
        while len(left):
            agree = (sketches[left] == sketches[left[0]]).sum(axis=1)
            forest.join(int(left[0]), left[agree >= need])
            left = left[1:][agree[1:] < PIVOT_COVER * SKETCH]
    return [(nodes[i], nodes[r]) for i in range(m) if (r := forest.root(i)) != i]


def candidate_links(reps: DataFrame) -> DataFrame:
    """(u, v) forests over nodes that share a bucket and could be similar."""
    spark = reps.sparkSession
    member = reps.select("node", F.explode("buckets").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    member = member.join(shared, "bucket").join(reps.select("node", "sketch"), "node")
    member = cells(member.withColumn("parts", F.ceil(F.col("size") / BUCKET_NODES)), "bucket", "parts")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for rows in groups(batches, 3):
            sketches = np.frombuffer(b"".join(r[4] for r in rows), "<u2").reshape(len(rows), SKETCH)
            out += sketch_links([r[3] for r in rows], sketches)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])

    key = ["bucket", "i", "j"]
    dealt = member.select(*key, "node", "sketch").repartition(partitions(spark), *key).sortWithinPartitions(*key, "node")
    return dealt.mapInArrow(task, "u long, v long")


def similar(common: np.ndarray, a: int, b: np.ndarray, threshold: float) -> np.ndarray:
    """Sets of sizes a and b with so many common members reach it."""
    return common >= threshold * (a + b - common) - 1e-9


def verify(sets: list[np.ndarray], weights: np.ndarray, blocks: np.ndarray, i: int, j: int, threshold: float) -> tuple[np.ndarray, Forest]:
    """Weight of similar others per set, and a forest over the links.  In a
    cell of two blocks only pairs between them count."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    links, forest = np.zeros(m, np.int64), Forest(m)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    new = np.concatenate([[True], flat[order[1:]] != flat[order[:-1]]])
    first = np.flatnonzero(new)
    run = np.empty(len(flat), np.int64)
    run[order] = np.cumsum(new) - 1
    length = np.diff(np.append(first, len(flat)))
    posting = owner[order]
    start = np.cumsum(sizes) - sizes
    for a in range(m):
        mine = run[start[a] : start[a] + sizes[a]]
        n = length[mine]
        total = int(n.sum())
        at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[mine], n)
        common = np.bincount(posting[at], minlength=m)
        near = similar(common, int(sizes[a]), sizes, threshold)
        near[a] = False
        if i != j:
            near &= blocks != blocks[a]
        found = np.flatnonzero(near)
        links[a] = weights[found].sum()
        forest.join(a, found)
    return links, forest


def picked_texts(docs: DataFrame, picks: DataFrame) -> DataFrame:
    """``picks`` with their text; the join key is a row's id and text hash,
    so rows that share an id or have none lie on many keys."""
    few = picks.count() <= BROADCAST_ROWS
    texts = hashed_texts(docs)
    own_row = (texts.text_hash == picks.rep_text) & texts.doc_id.eqNullSafe(picks.rep)
    return texts.join(F.broadcast(picks) if few else picks, own_row)


def verified(docs: DataFrame, picks: DataFrame, n: int, threshold: float) -> DataFrame:
    """Per node and cell of its component: links (rows similar to it there)
    and root, from the full sets of one text per node.

    ``picks``: node, rep and rep_text (the doc_id and text hash of a row with
    that set), weight, part (the component), blocks."""
    spark = docs.sparkSession
    rows = picked_texts(docs, picks)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngrams")
        seen: set[int] = set()
        for batch in batches:
            got, own = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
                # rows equal in id and text bring the same set: one per task
                # goes on; of two texts with equal hashes the set decides
                packed = b"" if k in seen else ngrams(text, n).tobytes()
                own.append(len(packed) > 0 and xxhash.xxh64_intdigest(packed) - (1 << 63) == k)
                got.append(packed)
                if own[-1]:
                    seen.add(k)
            cols = [*batch.columns[:4], pa.array(got, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "weight", "part", "blocks", "ngrams"]).filter(pa.array(own, pa.bool_()))

    with_sets = rows.select("node", "weight", "part", "blocks", "text").mapInArrow(
        sets, "node long, weight long, part long, blocks long, ngrams binary"
    )
    spread = cells(with_sets, "part", "blocks")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for held in groups(batches, 3):
            nodes = [r[3] for r in held]
            links, forest = verify(
                [np.frombuffer(r[6], np.uint64) for r in held],
                np.array([r[4] for r in held], np.int64),
                np.array([r[5] for r in held]),
                held[0][1],
                held[0][2],
                threshold,
            )
            out += [(nodes[k], int(links[k]), nodes[forest.root(k)]) for k in range(len(nodes))]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["node", "links", "root"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["node", "links", "root"])

    key = ["part", "i", "j"]
    dealt = spread.select(*key, "node", "weight", "block", "ngrams").repartition(partitions(spark), *key).sortWithinPartitions(*key, "node")
    return dealt.mapInArrow(task, "node long, links long, root long")


def classified(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """The profile of each row, and per node: rep (the smallest doc_id with
    that text), root (its class) and n_links."""
    bands, rows = plan_bands(threshold, recall)
    profile = to_table(profiles(docs, n, bands, rows), "profiles")
    full = profile.where(F.col("node").isNotNull())
    reps = to_table(
        full.groupBy("node").agg(
            F.count("*").alias("weight"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("row"),
            F.max("n").alias("n"),
            F.first("buckets").alias("buckets"),
            F.first("sketch").alias("sketch"),
        )
        .withColumn("rep", F.col("row.doc_id"))
        .withColumn("rep_text", F.col("row.text_hash"))
        .drop("row"),
        "nodes",
    )
    near = components(candidate_links(reps))
    # every node of a component, its smallest included
    part = near.select(F.col("u").alias("node"), F.col("v").alias("part")).union(near.select("v", "v").distinct())
    picks = part.join(reps.select("node", "weight", "rep", "rep_text", "n"), "node")
    size = picks.groupBy("part").agg(F.count("*").alias("nodes"), F.sum("n").alias("ngrams"))
    blocks = F.greatest(F.ceil(F.col("nodes") / CELL_NODES), F.ceil(F.col("ngrams") / CELL_NGRAMS))
    picks = to_table(picks.join(size.select("part", blocks.alias("blocks")), "part").select("node", "rep", "rep_text", "weight", "part", "blocks"), "picks")
    checked = to_table(verified(docs, picks, n, threshold), "checked")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    stars = components(checked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    root = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    nodes = (
        reps.select("node", "weight", "rep")
        .join(root, "node", "left")
        .join(links, "node", "left")
        .select("node", "rep", F.coalesce("root", "node").alias("root"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    return profile, nodes


def near_duplicates(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links: one row per row of ``docs``."""
    profile, nodes = classified(docs, n, threshold, recall)
    full = profile.where(F.col("node").isNotNull())
    classes = nodes.groupBy("root").agg(F.min("rep").alias("class_id"))
    result = nodes.join(classes, "root").select("node", "class_id", "n_links")
    out = full.select("doc_id", "node").join(result, "node").select("doc_id", "class_id", "n_links")
    empty = profile.where(F.col("node").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(empty)


def with_node(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__node``, as in ``profiles``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngrams")
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = [ngrams(t, NGRAM) for t in part.column(part.num_columns - 1).to_pylist()]
                nodes = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(nodes, pa.int64())], names=[*part.schema.names[:-1], "__node"])

    return rows.withColumn("__text", whole_text()).mapInArrow(task, T.StructType([*rows.schema.fields, T.StructField("__node", T.LongType())]))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per class, with all columns as they were: the
    smallest doc_id (none comes last), then the smallest n-gram set hash, then
    the first text.  Rows without words are a class per doc_id; those without
    doc_id as well all stay."""
    profile, nodes = classified(docs.select("doc_id", "text"))
    least = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("p")
    picks = to_table(nodes.groupBy("root").agg(least).select(F.col("p.rep").alias("__rep"), F.col("p.node").alias("__pick")), "class-picks")
    side = (lambda df: F.broadcast(df)) if picks.count() <= BROADCAST_ROWS else (lambda df: df)
    is_pick = lambda key, node: key.cast("long").eqNullSafe(F.col("__rep")) & (node == F.col("__pick"))
    # an id of one row tells whether that row stays; others are told by text
    shared = profile.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__gone"))
    shared = to_table(shared, "shared-ids")
    lost = profile.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    lost = lost.join(side(picks), is_pick(F.col("doc_id"), F.col("node")), "left_anti").select(F.col("doc_id").alias("__gone"))
    gone = to_table(lost.union(shared).distinct(), "dropped")
    few = gone.count() <= BROADCAST_ROWS
    known = docs.where(F.col("doc_id").isNotNull())
    kept = known.join(F.broadcast(gone) if few else gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    several = known.join(F.broadcast(shared) if few else shared, F.col("doc_id").cast("long") == F.col("__gone"), "left_semi")
    marked = with_node(several.unionByName(docs.where(F.col("doc_id").isNull())))
    first = Window.partitionBy("doc_id", "__node").orderBy("text")
    picked = marked.join(side(picks), is_pick(F.col("doc_id"), F.col("__node")), "left_semi")
    wordless = marked.where(F.col("__node").isNull() & F.col("doc_id").isNotNull())
    one = picked.unionByName(wordless).withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") == 1)
    nameless = marked.where(F.col("__node").isNull() & F.col("doc_id").isNull())
    return kept.unionByName(one.drop("__rank", "__node")).unionByName(nameless.drop("__node"))
