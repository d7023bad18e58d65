"""Packing documents into fixed-length training sequences by bin completion.

1. ``pieces``: each document's ids (plus the end id) are counted and cut,
   only where longer than a sequence, into sequence-long pieces.
2. ``pack``: pieces in the order of their length are dealt in turn to groups
   of about ``GROUP_SEQUENCES`` sequences' worth of tokens, and each group is
   packed alone by branch and bound.  The groups' counts of any length differ
   by one at most, so a group is the whole in small and fitting partners stay
   together; what the odd pieces and a last sequence per group cost against
   one global packing depends on the lengths.  No group grows with the corpus.

The search (``solve``) packs around the longest piece left: it enumerates the
undominated fillings of what that piece leaves free, least waste first, and
goes on with the next longest.  A branch ends when its waste already exceeds
what any better packing could have (sequences of the best known packing less
one, times the length, less all tokens).  It runs in rounds: the first looks
at few fillings, the longest pieces first; each further one at ``GROWTH``
times as many, until a round left nothing out, which proves the packing.  The
best-fit decreasing packing is the first incumbent; ``nodes`` (a parameter)
bounds the work of all rounds per group, after which the incumbent stands and
may have more sequences than the optimum (200 lengths of 700 to 2,000 end
with such a gap to the bound; the tests measure it).

Null text counts as empty (its piece holds the end id alone); repeated rows
are packed as often as they occur; null ids are kept; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylens.llm.caches import claim
from relaylens.llm.ship import partitions, ship, small, to_table, whole_text
from relaylens.llm.tokens import WORDS, encoder

CAPACITY = 4096
GROUP_SEQUENCES = 1024
#: Fillings expanded in one group's search (a bound of time, never of what is
#: packed).  Around one piece the first round looks at so many partial
#: fillings, of so many next sizes each, and keeps so many whole ones.
NODES = 6_000
TRIES = 400
REACH = 2
WIDTH = 4
GROWTH = 4
#: Bounds by parts are tried for halves, thirds and so on up to this many and one.
PARTS = 12

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, lane long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece; ``lane`` is a hash of its ids and number."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("lane", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokens")
        enc = encoder(tokenizer, WORDS)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in small(batches):
            cols: list[list] = [[] for _ in schema]
            for key, packed in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                ids = np.frombuffer(packed + end, enc.dtype).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    cut = ids[at : at + capacity]
                    crc = zlib.crc32(cut)
                    for c, v in zip(cols, (key, k, at, len(cut), crc, crc ^ (k * 0x9E3779B1))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(task, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; ``lengths`` descend."""
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for x in lengths:
        i = bisect_left(room, (x, -1))
        if i == len(room):
            bins.append([x])
            left, b = capacity - x, len(bins) - 1
        else:
            left, b = room.pop(i)
            bins[b].append(x)
            left -= x
        if left:
            insort(room, (left, b))
    return bins


class Stock:
    """Lengths still to pack: distinct sizes ascending, with counts."""

    def __init__(self, lengths: list[int]):
        self.count: dict[int, int] = {}
        for x in lengths:
            self.count[x] = self.count.get(x, 0) + 1
        self.sizes = sorted(self.count)

    def take(self, x: int) -> None:
        n = self.count[x] - 1
        if n:
            self.count[x] = n
        else:
            del self.count[x]
            self.sizes.pop(bisect_left(self.sizes, x))

    def give(self, x: int) -> None:
        n = self.count.get(x, 0)
        if not n:
            insort(self.sizes, x)
        self.count[x] = n + 1


def dominated(filling: tuple[int, ...], slack: int, stock: Stock) -> bool:
    """True if a piece outside the filling fits beside it, or in place of a
    smaller piece of it: packing that one here is never worse."""
    sizes = stock.sizes
    used: dict[int, int] = {}
    for x in filling:
        used[x] = used.get(x, 0) + 1
    for s in {0, *filling}:
        i = bisect_right(sizes, s + slack) - 1
        while i >= 0 and sizes[i] > s:
            if stock.count[sizes[i]] > used.get(sizes[i], 0):
                return True
            i -= 1
    return False


def fillings(room: int, stock: Stock, allowed: int, scale: int = 1) -> tuple[list[tuple[int, tuple[int, ...]]], int, bool]:
    """Undominated fillings of ``room`` as (waste, pieces), least waste first;
    none wastes more than ``allowed``.  Pieces are tried from the longest that
    fits.  Also the partial fillings looked at, and whether ``scale`` times
    the limits left any out; the first round ends at an exact filling."""
    sizes, count = stock.sizes, stock.count
    found: dict[tuple[int, ...], int] = {}
    tries, reach, width, cut = 0, REACH * scale, WIDTH * scale, False
    stack: list[tuple[int, int, tuple[int, ...]]] = [(room, len(sizes), ())]
    while stack:
        if tries == TRIES * scale:
            cut = True
            break
        tries += 1
        left, below, chosen = stack.pop()
        hi = min(bisect_right(sizes, left), below)
        if not hi or not left:
            if left <= allowed and chosen not in found and not dominated(chosen, left, stock):
                found[chosen] = left
                if not left and scale == 1:
                    cut |= bool(stack)
                    break
            continue
        cut |= hi > reach
        for i in range(max(0, hi - reach), hi):
            x = sizes[i]
            more = count[x] > chosen.count(x) + 1
            stack.append((left - x, i + 1 if more else i, chosen + (x,)))
    best = sorted((w, c) for c, w in found.items())
    return best[:width], tries, cut or len(best) > width


def least_sequences(lengths: list[int], capacity: int = CAPACITY) -> int:
    """A number of sequences that no packing can go below.

    By volume; by halves (for each size ``a`` up to half a sequence: pieces
    above half a sequence lie apart, and those of ``a`` to half have only the
    room beside the ones that leave ``a`` or more); and by parts (for each k,
    a piece weighs the whole k + 1-ths of a sequence in it, less where it is
    that and no more, over k: no full sequence weighs above 1)."""
    if not lengths:
        return 0
    x = np.sort(np.asarray(lengths, np.int64))
    total = np.concatenate([[0], np.cumsum(x)])
    bound = -(-int(total[-1]) // capacity)
    half = int(np.searchsorted(x, capacity // 2, "right"))
    large = len(x) - half
    a = np.unique(x[:half])
    if len(a):
        small = total[half] - total[np.searchsorted(x, a, "left")]
        # pieces above half a sequence that leave room for a piece of size a
        open_to = np.searchsorted(x, capacity - a, "right")
        room = (open_to - half) * capacity - (total[open_to] - total[half])
        large += max(0, int((-(-(small - room) // capacity)).max()))
    bound = max(bound, large)
    for k in range(1, PARTS + 1):
        parts, rest = np.divmod(x * (k + 1), capacity)
        # in units of 1 / (k * capacity), exactly
        weight = int(np.where(rest == 0, x * k, parts * capacity).sum())
        bound = max(bound, -(-weight // (k * capacity)))
    return bound


def solve(lengths: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    """The lengths of each sequence, as few as the search finds."""
    lengths = sorted(lengths, reverse=True)
    least = least_sequences(lengths, capacity)
    best = best_fit(lengths, capacity)
    if len(best) == least:
        return best
    scale, left = 1, float(nodes)
    while left > 0 and len(best) > least:
        best, left, cut = search(lengths, capacity, best, left, scale, least)
        if not cut:
            break
        scale *= GROWTH
    return best


def search(lengths: list[int], capacity: int, best: list[list[int]], nodes: float, scale: int, least: int) -> tuple[list[list[int]], float, bool]:
    """One round: the best packing, the nodes left, and whether a filling was
    left out.  ``least`` sequences end it."""
    total = sum(lengths)
    stock = Stock(lengths)
    path: list[list[int]] = []
    wasted = [0]
    cut = False

    def branch() -> Iterator[tuple[int, tuple[int, ...]]]:
        """Fillings around the longest piece left, which is taken out."""
        nonlocal nodes, cut
        x = stock.sizes[-1]
        stock.take(x)
        allowed = (len(best) - 1) * capacity - total - wasted[-1]
        options, tries, more = fillings(capacity - x, stock, allowed, scale)
        stock.give(x)
        # looking longer than the first round may is work as well
        nodes -= max(0.0, tries / TRIES - 1)
        cut |= more
        return iter([(w, (x, *c)) for w, c in options])

    levels = [branch()]
    while levels and nodes > 0:
        allowed = (len(best) - 1) * capacity - total
        step = next(((w, f) for w, f in levels[-1] if wasted[-1] + w <= allowed), None)
        if step is None:
            levels.pop()
            if path:
                for x in path.pop():
                    stock.give(x)
                wasted.pop()
            continue
        nodes -= 1
        waste, filling = step
        for x in filling:
            stock.take(x)
        path.append(list(filling))
        wasted.append(wasted[-1] + waste)
        if stock.sizes:
            levels.append(branch())
            continue
        if len(path) < len(best):
            best = [list(f) for f in path]
            if len(best) == least:
                break
        for x in path.pop():
            stock.give(x)
        wasted.pop()
    return best, nodes, cut


def place(group: pd.DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> pd.DataFrame:
    """One group's rows with their sequence (from 0) and offset.  Which of
    several pieces of a length goes where follows their order by id."""
    g = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], na_position="first", kind="stable").reset_index(drop=True)
    lengths = g["length"].to_numpy()
    at: dict[int, int] = {}
    for i in range(len(lengths) - 1, -1, -1):
        at[int(lengths[i])] = i
    sequence, offset = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
    for b, filling in enumerate(solve([int(x) for x in lengths], capacity, nodes)):
        used = 0
        for x in filling:
            i = at[x]
            at[x] = i + 1
            sequence[i], offset[i] = b, used
            used += x
    g["sequence_id"], g["offset"] = sequence, offset
    return g


def pack(cut: DataFrame, capacity: int = CAPACITY, group_sequences: int = GROUP_SEQUENCES, nodes: int = NODES) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``.  The group count comes
    from the total token count, so a group's size is bounded by
    ``group_sequences`` whatever the corpus holds; ``nodes`` bounds the search
    in each."""
    spark = cut.sparkSession
    ship(spark)
    cut = to_table(cut, "pieces")
    total = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (capacity * group_sequences)))

    def task(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = place(frame, capacity, nodes)
        out["doc_id"] = out["doc_id"].astype("Int64")
        out["sequence_id"] += int(key[0]) << 32
        return out[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    if groups == 1:
        return cut.withColumn("lane", F.lit(0).cast("long")).groupBy("lane").applyInPandas(task, PACKED)
    # the place in the written table tells equal rows apart (it is fixed once
    # the table is), so a length of any number of rows can be cut into ranges
    spread = F.xxhash64("doc_id", "piece", "lane", F.monotonically_increasing_id())
    by_length = cut.withColumn("spread", spread).repartitionByRange(partitions(spark), "length", "spread").sortWithinPartitions("length", "spread")
    at = F.monotonically_increasing_id()
    placed = to_table(by_length.withColumn("range", F.shiftright(at, 33)).withColumn("at", at.bitwiseAND((1 << 33) - 1)), "by-length")
    # a row per range; a row's place in the whole order gives its group
    sizes = sorted(map(tuple, placed.groupBy("range").count().collect()))
    ends = accumulate(n for _, n in sizes)
    before = [(r, (end - n) % groups) for (r, n), end in zip(sizes, ends)]
    begin = spark.createDataFrame(before, "range long, begin long")
    dealt = placed.join(F.broadcast(begin), "range").withColumn("lane", F.pmod(F.col("at") + F.col("begin"), F.lit(groups)))
    return dealt.select(cut.columns).groupBy("lane").applyInPandas(task, PACKED)
