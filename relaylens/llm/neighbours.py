"""Approximate nearest neighbours by multiprobe p-stable hashing.

Nearness is the largest inner product.  Vectors are lifted to one more
dimension so that all have the shard's largest norm; distance then orders as
the inner product does.  A hash is ``floor((a . x + b) / w)`` with Gaussian
``a`` (2-stable); ``HASHES`` of them make a table's bucket, and there are
``TABLES`` tables.  A query visits its own bucket and ``PROBES`` - 1
perturbed ones per table: its distances to the bucket's borders are sorted,
and perturbation sets over those ranks come in the order of their expected
score, so the likeliest buckets come first.  The k-th best row they reach
bounds the distance of the true k-th; from it follows the chance (over the
hash functions) that a row so near lies in a visited bucket of some table,
and a query goes on to further buckets until that chance is ``CHANCE``.
Where all buckets one step away (``MOST_PROBES``) don't reach it, the query
visits every row of the shard.  So
the work follows the data, and no count of rows decides.  Candidates of all
tables are merged and ranked by exact inner products of the original vectors.

Rows are cut into bands by norm (a factor of ``BAND`` each, the last open
below) and dealt by a hash of their id to shards of about ``SHARD_ROWS``
rows of one band, each an index of its own over all tables, lifted by its
own largest norm; queries are dealt to blocks of about ``QUERY_ROWS``.
Every shard meets every block once, and a block keeps k rows per query and
shard.  A hot bucket is thus spread over all shards; no task holds more than
one shard and one block.  Queries that find fewer than
k candidates are searched again against all rows of every shard (the exact
way for the rest), so small tables give whole results.

Vectors that are null, zero, of another length than the table's most common
one, or hold null or non-finite components take no part.  Repeated ids are
rows of their own; a query never finds a row of its own id; ties go to the
smaller id.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylens.llm.ship import ship, to_table

TABLES, HASHES, WIDTH, PROBES = 4, 8, 2.0, 300
#: The chance to reach a row as near as the k-th best, and the most buckets
#: per table (all that differ by one step in any of the hashes).
CHANCE, MOST_PROBES = 0.97, 3**HASHES
BAND, BANDS = 0.8, 16
SHARD_ROWS, QUERY_ROWS = 16_384, 4_096
#: Queries handled at once within a task.
TOGETHER = 64
SEED = 20_240
#: The normal distribution function, for interpolation.
_GRID = np.linspace(-8, 8, 16_001)
_NORMAL = np.array([math.erfc(-v / math.sqrt(2)) / 2 for v in _GRID])
FOUND = "query_id long, vec_id long, score double"


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    )
    # one value per distinct length: a handful
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return rows.join(F.broadcast(common.select("n")), F.size("v") == F.col("n"), "left_semi")


@cache
def perturbations(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks (0 the nearest border) in the order of expected score;
    the empty set, the query's own bucket, comes first.  A rank and its
    mirror are the two borders of one hash, so no set holds both."""
    m = hashes
    rank = np.arange(1, 2 * m + 1)
    near = rank * (rank + 1) / (4 * (m + 1) * (m + 2))
    other = 2 * m + 1 - rank
    far = 1 - other / (m + 1) + other * (other + 1) / (4 * (m + 1) * (m + 2))
    expected = np.where(rank <= m, near, far)
    out: list[tuple[int, ...]] = [()]
    heap = [(float(expected[0]), (0,))]
    while heap and len(out) < probes:
        score, ranks = heapq.heappop(heap)
        if len({min(r, 2 * m - 1 - r) for r in ranks}) == len(ranks):
            out.append(ranks)
        last = ranks[-1] + 1
        if last < 2 * m:
            grown = score + float(expected[last])
            heapq.heappush(heap, (grown, (*ranks, last)))
            heapq.heappush(heap, (grown - float(expected[last - 1]), (*ranks[:-1], last)))
    return out


class Tables:
    """The hash functions, the same in every task."""

    def __init__(self, dims: int, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.hashes, self.width = hashes, width
        self.planes = rng.standard_normal((tables, dims, hashes))
        self.shift = rng.uniform(0, width, (tables, hashes))
        # a bucket's number; overflow wraps, which only merges buckets
        self.base = rng.integers(1, 1 << 62, (tables, hashes), dtype=np.int64) | 1
        self.first = probes
        sets = perturbations(hashes, max(probes, min(MOST_PROBES, 3**hashes)))
        self.choose = np.zeros((len(sets), 2 * hashes), np.int64)
        for i, ranks in enumerate(sets):
            self.choose[i, list(ranks)] = 1

    def bins(self, t: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = (x @ self.planes[t] + self.shift[t]) / self.width
        h = np.floor(f)
        return h.astype(np.int64), f - h

    def key(self, t: int, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h * self.base[t]).sum(axis=1)

    def order(self, rest: np.ndarray) -> np.ndarray:
        """Steps (down per hash, then up) by distance to the border."""
        return np.argsort(np.concatenate([rest, 1 - rest], axis=1), axis=1, kind="stable")

    def probes(self, t: int, x: np.ndarray, a: int = 0, b: int | None = None) -> np.ndarray:
        """Bucket numbers to visit per query, likeliest first; ``a`` to ``b``
        of them."""
        h, rest = self.bins(t, x)
        step = np.concatenate([-self.base[t], self.base[t]])
        with np.errstate(over="ignore"):
            return self.key(t, h)[:, None] + step[self.order(rest)] @ self.choose[a : self.first if b is None else b].T

    def needed(self, x: np.ndarray, distance: np.ndarray, chance: float) -> np.ndarray:
        """How many buckets of each table a query has to visit so that a row
        at its distance is in one of them with that chance; one more than all
        of them where they don't reach it."""
        miss = np.ones((len(x), len(self.choose)))
        d = np.maximum(distance, 1e-9)[:, None]
        for t in range(len(self.planes)):
            rest = self.bins(t, x)[1] * self.width
            # the row's projection is the query's plus a normal of deviation d
            border = [np.interp(v / d, _GRID, _NORMAL) for v in (-rest - self.width, -rest, self.width - rest, 2 * self.width - rest)]
            stay, down, up = (np.log(np.maximum(v, 1e-12)) for v in (border[2] - border[1], border[1] - border[0], border[3] - border[2]))
            step = np.take_along_axis(np.concatenate([down - stay, up - stay], axis=1), self.order(rest / self.width), axis=1)
            part = np.exp(stay.sum(axis=1)[:, None] + step @ self.choose.T.astype(float))
            miss *= 1 - np.minimum(1.0, np.cumsum(part, axis=1))
        enough = 1 - miss >= chance
        return np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, len(self.choose) + 1)


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows scaled to the unit ball and lifted to the unit sphere."""
    u = x / norm
    return np.column_stack([u, np.sqrt(np.maximum(0.0, 1 - (u * u).sum(axis=1)))])


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, candidates: Iterator[np.ndarray], k: int) -> list[tuple]:
    """The k nearest candidates of each query, exactly."""
    out = []
    reach = np.linalg.norm(x, axis=1).max()
    for a in range(0, len(queries), TOGETHER):
        part = queries[a : a + TOGETHER]
        products = part @ x.T
        for qid, q, near, rows in zip(query_ids[a : a + TOGETHER].tolist(), part, products, candidates):
            rows = rows[ids[rows] != qid]
            if len(rows) > k:
                # every row that ties the k-th stays in the running; products of
                # many rows at once may differ from a row's own in the last bits
                near = near[rows]
                limit = np.partition(near, len(rows) - k)[len(rows) - k]
                rows = rows[near >= limit - 1e-12 * reach * np.linalg.norm(q)]
            scores = (x[rows] * q).sum(axis=1)
            order = np.lexsort((ids[rows], -scores))[:k]
            out += [(qid, int(ids[r]), float(s)) for r, s in zip(rows[order], scores[order])]
    return out


def candidates(tables: Tables, x: np.ndarray, queries: np.ndarray, k: int = 20) -> Iterator[np.ndarray]:
    """Row numbers that each query's probes reach, in all tables; all rows
    and queries have length 1."""
    built = [np.unique(tables.key(t, tables.bins(t, x)[0]), return_inverse=True) for t in range(len(tables.planes))]

    def visit(seen: np.ndarray, part: np.ndarray, a: int, b: int, need: np.ndarray) -> None:
        """Mark the rows in buckets ``a`` to ``b``, as far as each query needs."""
        wanted = np.arange(a, b) < need[:, None]
        row = np.nonzero(wanted)[0]
        for t, (keys, bucket_of) in enumerate(built):
            # by occupied buckets, which are far fewer than rows
            bucket = tables.probes(t, part, a, b)[wanted]
            at = np.minimum(np.searchsorted(keys, bucket), len(keys) - 1)
            held = keys[at] == bucket
            hit = np.zeros((len(part), len(keys)), bool)
            hit[row[held], at[held]] = True
            seen |= np.take(hit, bucket_of, axis=1)

    for a in range(0, len(queries), TOGETHER):
        part = queries[a : a + TOGETHER]
        seen = np.zeros((len(part), len(x)), bool)
        visit(seen, part, 0, tables.first, np.full(len(part), tables.first))
        # the query's own row may be one of them, so one more than k
        far = np.full(len(part), 2.0)
        products = part @ x.T
        for i in range(len(part)):
            near = products[i, seen[i]]
            if len(near) > k:
                far[i] = np.sqrt(max(0.0, 2 - 2 * np.partition(near, len(near) - k - 1)[len(near) - k - 1]))
        need = tables.needed(part, far, CHANCE)
        if need.max() > tables.first:
            visit(seen, part, tables.first, min(int(need.max()), len(tables.choose)), need)
        seen[need > len(tables.choose)] = True
        for i in range(len(part)):
            yield np.flatnonzero(seen[i])


def search(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, **params) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest.

    ``params`` go to ``Tables``; rows for which ``is_query`` (an expression
    over vec_id) holds are the queries, all rows are candidates."""
    spark = vectors.sparkSession
    ship(spark)
    rows = clean(vectors)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    stats = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.size("v")), F.max(length)).first()
    n, n_queries, dims, norm = stats[0], stats[1], stats[2] or 0, stats[3] or 1.0
    # rounded, so that equal norms with rounding errors share a band
    band = F.least(F.floor(F.log(length / F.lit(norm)) / F.lit(float(np.log(BAND))) + 1e-4), F.lit(BANDS - 1)).cast("int")
    # at most ``BANDS`` rows
    parts = {r.band: max(1, -(-r["count"] // shard_rows)) for r in rows.groupBy(band.alias("band")).count().collect()}
    starts = {b: sum(parts[c] for c in parts if c < b) for b in parts}
    shards, blocks = max(1, sum(parts.values())), max(1, -(-n_queries // query_rows))
    lot = lambda parts, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(parts)).cast("int")
    shard = F.lit(0)
    for b in parts:
        shard = F.when(band == b, lot(parts[b], "shard") + starts[b]).otherwise(shard)

    def grid(queries: DataFrame, whole: bool) -> DataFrame:
        """Each shard against each block; ``whole`` visits every row."""

        def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
            ids, x = left["id"].to_numpy(), np.stack(left["v"].to_list())
            q_ids, q = right["query_id"].to_numpy(), np.stack(right["q"].to_list())
            if whole:
                found = iter([np.arange(len(ids))] * len(q_ids))
            else:
                unit = q / np.linalg.norm(q, axis=1, keepdims=True)
                own = float(np.linalg.norm(x, axis=1).max())
                found = candidates(Tables(dims + 1, **params), lifted(x, own), np.column_stack([unit, np.zeros(len(q))]), k)
            return pd.DataFrame(best(q_ids, q, ids, x, found, k), columns=["query_id", "vec_id", "score"])

        left = rows.select(F.col("vec_id").alias("id"), "v", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        right = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), lot(blocks, "block").alias("block"))
        cell = ["shard", "block"]
        return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(task, FOUND)

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # a repeated query id counts once, with its smallest vector
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    first = to_table(ranked(grid(queries, False)), "neighbours").select("query_id", "rank", "vec_id", "score")
    enough = first.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1)).select(F.col("query_id").alias("vec_id"))
    short = queries.join(enough, "vec_id", "left_anti")
    if short.isEmpty():
        return first
    again = ranked(grid(short, True)).select("query_id", "rank", "vec_id", "score")
    settled = first.join(enough.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi")
    return settled.unionByName(again)
