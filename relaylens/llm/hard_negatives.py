"""Hard-negative mining with bounds along spanning trees of the anchors.

Anchors of one label that lie near each other make a block, and a block has a
minimum spanning tree by Euclidean distance.  For a row ``x`` and an edge from
parent ``p`` to child ``c``

    | c . x  -  p . x |  <=  |c - p| * |x|

so the parent's score (or the bounds known for it) plus or minus edge length
times the row's norm bounds the child's.  At the root every row is scored; at
a child only rows whose bounds can matter:

* *positives* (rows of the anchor's label): those whose upper bound reaches
  the k-th largest lower bound;
* *negatives* (other labels): those whose bounds overlap a window
  [``low``, ``high``] percent of a positive's score and whose upper bound
  reaches the k-th largest lower bound among rows surely inside it.

Rows that are not scored hand their bounds on, wider by each edge.  So the
lists are exact; the bounds only save scoring.

Rows are cut to chunks of ``CHUNK_ROWS`` by a hash; each task takes its rows
once and reads the blocks of anchors (the stated query set) one after another
from a table in the shared folder, so no row is copied per block and nothing
is broadcast.  Per anchor and chunk at most ``positives`` (or ``positives`` x
``negatives``) rows leave a task; windows keep the best of them.  Anchors are
dealt to blocks by ranges of (length, label, a fixed projection, id), which
keeps near ones together and bounds a block whatever a label's share.

Components become ``floor(scale * x)``; a score is the integer inner product.
It is exact in double precision where length x largest components stays
below 2**53; rows and anchors beyond that are scored in whole numbers of any
size, and scores past 64 bits count as the nearest 64-bit number.

Rows without an id, label or vector, or with a component that is null or not
finite (scaled or not), take no part.  Rows equal in id, label and vector count once; a row is never
paired with one of its own id; rows of the same id but other contents are rows
(and anchors) of their own; vectors are compared with those of their own
length.  Ties go to the smaller id.  Other columns are not read.  Without
anchors, positives or negatives there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylens.llm.ship import open_fs, ship
from relaylens.session import scratch_path

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
BLOCK_ANCHORS, CHUNK_ROWS = 512, 16_384
LONG = (1 << 63) - 1

BLOCK = "block long, ids binary, keys binary, label long, dims long, vectors binary, parents binary, edges binary, wide binary, windows string"
POSITIVE = "anchor_id long, anchor_key long, block long, positive_id long, score long"
NEGATIVE = "anchor_id long, anchor_key long, positive_id long, negative_id long, positive_score long, negative_score long"


def clean(vectors: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    # floor() of a double is a long; huge components stay doubles, which are whole
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad))
    rows = rows.select("vec_id", "label", F.transform("v", lambda x: whole(x * F.lit(float(scale)))).alias("x"))
    return rows.where(~F.exists("x", bad))


class Rows:
    """Some rows of one length."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.dims = x.shape[1]
        limit = math.sqrt(2.0**53 / max(1, self.dims)) * (1 - 1e-9)
        big = np.abs(x).max(axis=1, initial=0)
        self.wide = big >= limit
        with np.errstate(over="ignore"):
            self.norms = np.sqrt((x * x).sum(axis=1))

    def take(self, mask: np.ndarray) -> "Rows":
        return Rows(self.ids[mask], self.labels[mask], self.x[mask])


def whole_scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers, held to 64 bits."""
    left = [int(v) for v in a]
    sums = (sum(p * int(q) for p, q in zip(left, row)) for row in x)
    return np.array([max(-LONG - 1, min(LONG, s)) for s in sums], np.int64)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parents, edges) of a minimum spanning tree, from the row
    nearest the mean; a parent comes before its children."""
    n = len(x)
    root = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    parents, edges = np.full(n, -1), np.full(n, np.inf)
    order, left = [], np.ones(n, bool)
    edges[root] = 0
    for _ in range(n):
        at = int(np.argmin(np.where(left, edges, np.inf)))
        left[at] = False
        order.append(at)
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        closer = left & (d < edges)
        parents[closer], edges[closer] = at, d[closer]
    # depth first, so that few nodes' bounds are held at once
    children: dict[int, list[int]] = {}
    for at in order:
        children.setdefault(int(parents[at]), []).append(at)
    walk, stack = [], list(children.get(-1, []))
    while stack:
        at = stack.pop()
        walk.append(at)
        stack.extend(children.get(at, []))
    return np.array(walk, np.int64), parents.astype(np.int64), edges


def _trees(anchors: pd.DataFrame, windows: dict[tuple[int, int], list] | None = None) -> Iterator[tuple]:
    """The anchors of one block, a row per length and label, in tree order."""
    anchors = anchors.assign(dims=anchors["x"].map(len))
    for (dims, label), g in anchors.groupby(["dims", "label"], sort=True):
        g = g.sort_values(["vec_id", "key"])
        x = np.array(g["x"].tolist(), np.float64).reshape(len(g), int(dims))
        wide = np.abs(x).max(axis=1, initial=0) >= math.sqrt(2.0**53 / max(1, dims)) * (1 - 1e-9)
        tame = np.where(wide[:, None], 0.0, x)  # wide anchors are scored in full, the tree passes them by
        order, parents, edges = spanning_tree(tame)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        up = np.where(parents[order] < 0, -1, place[parents[order]])
        ids, keys = g["vec_id"].to_numpy(np.int64)[order], g["key"].to_numpy(np.int64)[order]
        text = "" if windows is None else ";".join(
            ",".join(f"{p}:{s}" for p, s in windows.get((int(i), int(k)), [])) for i, k in zip(ids, keys)
        )
        yield (
            int(g["block"].iloc[0]), ids.tobytes(), keys.tobytes(), int(label), int(dims), x[order].tobytes(),
            up.tobytes(), edges[order].tobytes(), wide[order].tobytes(), text,
        )


def _block(anchors: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(list(_trees(anchors)), columns=[c.split()[0] for c in BLOCK.split(", ")])


def _block_with_windows(anchors: pd.DataFrame, positives: pd.DataFrame) -> pd.DataFrame:
    windows: dict[tuple[int, int], list] = {}
    for r in positives.sort_values(["score", "positive_id"], ascending=[False, True]).itertuples(index=False):
        windows.setdefault((int(r.anchor_id), int(r.anchor_key)), []).append((int(r.positive_id), int(r.score)))
    columns = [c.split()[0] for c in BLOCK.split(", ")]
    return pd.DataFrame(list(_trees(anchors, windows)) if len(anchors) else [], columns=columns)


class Anchors:
    """One row of the table of blocks."""

    def __init__(self, r: dict):
        self.block, self.label, self.dims = r["block"], r["label"], r["dims"]
        self.ids, self.keys = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["keys"], np.int64)
        self.x = np.frombuffer(r["vectors"], np.float64).reshape(len(self.ids), self.dims)
        self.parents, self.edges = np.frombuffer(r["parents"], np.int64), np.frombuffer(r["edges"], np.float64)
        self.wide = np.frombuffer(r["wide"], bool)
        self.windows = [
            [tuple(map(int, w.split(":"))) for w in part.split(",") if w] for part in (r["windows"].split(";") if r["windows"] else [])
        ] or [[] for _ in self.ids]


def read_blocks(path: str) -> Iterator[Anchors]:
    """The blocks of anchors in the shared folder, one at a time."""
    files, base = open_fs(path)
    found = files.get_file_info(fs.FileSelector(base, recursive=False))
    for f in sorted(f.path for f in found if f.path.endswith(".parquet")):
        for batch in pq.ParquetFile(files.open_input_file(f)).iter_batches(batch_size=4):
            for r in batch.to_pylist():
                yield Anchors(r)


def scored_nodes(anchors: Anchors, rows: Rows, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, places, scores) of the rows that ``wanted(anchor, lo, hi)``
    asks for by their bounds; all rows at the root.  Wide rows and anchors are
    scored in whole numbers, always; in the tree a wide anchor is the zero
    vector, whose scores are known."""
    tame = ~rows.wide
    children = np.bincount(anchors.parents[anchors.parents >= 0], minlength=len(anchors.ids))
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for at, up in enumerate(anchors.parents.tolist()):
        if anchors.wide[at]:
            lo = hi = np.zeros(len(rows.ids))
            places = np.arange(len(rows.ids))
            scores = whole_scores(anchors.x[at], rows.x)
        else:
            need = np.ones(len(rows.ids), bool)
            lo, hi = np.full(len(rows.ids), -np.inf), np.full(len(rows.ids), np.inf)
            if up >= 0:
                # a little wider than the bound, for the rounding of doubles
                slack = anchors.edges[at] * rows.norms[tame] * (1 + 1e-9) + 1.0
                lo[tame], hi[tame] = held[up][0][tame] - slack, held[up][1][tame] + slack
                need = wanted(at, lo, hi) | rows.wide
            places = np.flatnonzero(need)
            plain = tame[places]
            exact = rows.x[places[plain]] @ anchors.x[at]
            scores = np.zeros(len(places), np.int64)
            scores[plain] = exact.astype(np.int64)
            scores[~plain] = whole_scores(anchors.x[at], rows.x[places[~plain]])
            lo[places[plain]] = hi[places[plain]] = exact
        if children[at]:
            held[at] = (lo, hi)
        if up >= 0:
            children[up] -= 1
            if not children[up]:
                del held[up]
        yield at, places, scores


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores, ties to the smaller id."""
    some = np.arange(len(scores))
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.lexsort((ids[some], -np.maximum(scores[some], -LONG)))[:k]]


def kth(lo: np.ndarray, k: int) -> float:
    """The k-th largest lower bound; minus infinity for fewer."""
    return float(np.partition(lo, len(lo) - k)[len(lo) - k]) if len(lo) >= k else -math.inf


def positives_of(anchors: Anchors, rows: Rows, k: int) -> Iterator[tuple]:
    rows = rows.take(rows.labels == anchors.label)
    if not len(rows.ids):
        return

    def wanted(at, lo, hi):
        other = rows.ids != anchors.ids[at]
        return other & (hi >= kth(lo[other], k))

    for at, places, scores in scored_nodes(anchors, rows, wanted):
        keep = rows.ids[places] != anchors.ids[at]
        ids, scores = rows.ids[places][keep], scores[keep]
        for i in _best(ids, scores, k):
            yield int(anchors.ids[at]), int(anchors.keys[at]), anchors.block, int(ids[i]), int(scores[i])


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The whole numbers s with low * score <= 100 * s <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


def negatives_of(anchors: Anchors, rows: Rows, k: int, low: int, high: int) -> Iterator[tuple]:
    rows = rows.take(rows.labels != anchors.label)
    if not len(rows.ids):
        return
    ranges = [[(p, s, *window(s, low, high)) for p, s in ws] for ws in anchors.windows]

    def wanted(at, lo, hi):
        need = np.zeros(len(rows.ids), bool)
        other = rows.ids != anchors.ids[at]
        for _, _, least, most in ranges[at]:
            if least > most:
                continue
            inside = other & (lo >= least) & (hi <= most)
            need |= (hi >= max(least, kth(lo[inside], k))) & (lo <= most)
        return need

    for at, places, scores in scored_nodes(anchors, rows, wanted):
        ids = rows.ids[places]
        other = ids != anchors.ids[at]
        for p, s, least, most in ranges[at]:
            inside = np.flatnonzero(other & (scores >= least) & (scores <= most))
            for i in inside[_best(ids[inside], scores[inside], k)]:
                yield int(anchors.ids[at]), int(anchors.keys[at]), p, int(ids[i]), s, int(scores[i])


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Rows]]:
    """The rows of a chunk by the length of their vectors."""

    def made(held):
        table = pa.Table.from_batches(held)
        x = table.column("x").combine_chunks()
        sizes = np.asarray(x.value_lengths())
        flat, ends = np.asarray(x.flatten()), np.cumsum(sizes)
        ids, labels = np.asarray(table.column("vec_id")), np.asarray(table.column("label"))
        out = []
        for dims in np.unique(sizes):
            at = np.flatnonzero(sizes == dims)
            where = (ends[at] - dims)[:, None] + np.arange(dims)
            out.append(Rows(ids[at], labels[at], flat[where] if dims else np.zeros((len(at), 0))))
        return out

    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= CHUNK_ROWS:
            yield made(held)
            held, count = [], 0
    if count:
        yield made(held)


def _searched(path: str, search, schema: str):
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_length(batches):
            for anchors in read_blocks(path):
                for same in rows:
                    if same.dims == anchors.dims and (found := list(search(anchors, same))):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names)

    return run


def mine(
    vectors: DataFrame,
    anchor: Column,
    label: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """Per anchor and positive the best ``negatives`` rows of other labels in
    the window.  ``anchor`` is a condition on ``vec_id``, ``label`` an
    expression over the input."""
    spark = vectors.sparkSession
    ship(spark)
    rows = clean(vectors, label, scale)
    # one scalar; chunks then hold about CHUNK_ROWS rows at every size
    chunks = max(1, -(-rows.count() // CHUNK_ROWS))
    path = scratch_path(spark, "negative-rows")
    same = rows.repartition(chunks, "vec_id", "label", "x").dropDuplicates(["vec_id", "label", "x"])
    same.withColumn("key", F.xxhash64("vec_id", "label", "x")).write.parquet(path)
    rows = spark.read.parquet(path)

    chosen = rows.where(anchor)
    blocks = max(1, -(-chosen.count() // BLOCK_ANCHORS))
    turn = F.aggregate(F.transform("x", lambda v, i: F.when(i % 2 == 0, v).otherwise(-v)), F.lit(0.0), lambda s, v: s + v)
    dealt = chosen.withColumn("dims", F.size("x")).withColumn("turn", turn)
    dealt = dealt.repartitionByRange(blocks, "dims", "label", "turn", "vec_id", "key")
    at = scratch_path(spark, "negative-anchors")
    dealt.select("vec_id", "label", "x", "key", F.spark_partition_id().cast("long").alias("block")).write.parquet(at)
    dealt = spark.read.parquet(at)

    trees = scratch_path(spark, "anchor-trees")
    dealt.groupBy("block").applyInPandas(_block, BLOCK).write.parquet(trees)
    k = positives
    found = rows.select("vec_id", "label", "x").mapInArrow(_searched(trees, lambda a, r: positives_of(a, r, k), POSITIVE), POSITIVE)
    best = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives).drop("place")

    windows = scratch_path(spark, "anchor-windows")
    both = dealt.groupBy("block").cogroup(found.groupBy("block"))
    both.applyInPandas(_block_with_windows, BLOCK).write.parquet(windows)
    m = negatives
    met = rows.select("vec_id", "label", "x").mapInArrow(
        _searched(windows, lambda a, r: negatives_of(a, r, m, low, high), NEGATIVE), NEGATIVE
    )
    rank = Window.partitionBy("anchor_id", "anchor_key", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = met.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
